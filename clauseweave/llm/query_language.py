"""Queries over pages, segments and documents together: p2 (languages)."""

from pyspark.sql import functions as F

from clauseweave.llm.encoding import garbled_ids
from clauseweave.llm.language import label_parts, sampled_sentences, stated, train
from clauseweave.llm.queries import LLM
from clauseweave.llm.site_tree import judge_pages
from clauseweave.plans.session import cut, stash, table

SAMPLE_ROWS = 4_000  # rows of each table from which the field is trained
SAMPLE_TASKS = 12  # tasks that label them


def latest(df, key, by):
    """One row per key: the one loaded last."""
    rest = [c for c in df.columns if c not in (key, by)]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.coalesce(by, F.lit("1900-01-01").cast("timestamp"))).alias("_r")).select(key, *[F.col(f"_r.{c}") for c in rest])


def sample_hash(key):
    return F.xxhash64(key, F.length("text"))


def texts(spark, folder):
    """(documents, segments, page leaves) as (record_id, lang, text), the pages' languages and the ids of garbled documents.

    The documents still hold the garbled ones. They also have their ``sample_hash`` h: taken before
    any join, it is counted without their texts.
    """
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("record_id"), "lang", "text", sample_hash("doc_id").alias("h"))
    bad = cut(garbled_ids(docs.select("record_id", "text"), "record_id"))
    seg = table(spark, folder, "segments").where("segment_type = 'TEXT' and size(tokens) >= 8").select("seg_uid", "lang", F.concat_ws(" ", "tokens").alias("text"), "loaded_at")
    seg = latest(seg, "seg_uid", "loaded_at").select(F.col("seg_uid").alias("record_id"), "lang", "text")
    page = judge_pages(table(spark, folder, "a11y_nodes"), prose=True).select(F.col("page_id").alias("record_id"), F.col("name").alias("text"))
    lang = latest(table(spark, folder, "a11y_tree").select("page_id", "lang", "loaded_at"), "page_id", "loaded_at")
    return docs, seg, page, lang.select(F.col("page_id").alias("record_id"), "lang"), bad


def sample_of(df):
    """``SAMPLE_ROWS`` rows by a hash: of the id and the length.

    Rows are counted by the first byte of the hash before, so that only texts up to the byte that
    completes the sample are sorted.
    """
    h = F.col("h") if "h" in df.columns else sample_hash("record_id")
    rows = df.where("length(text) > 30").select("text", "lang", h.alias("h"))
    n, last = 0, 127
    for r in sorted(rows.groupBy(F.shiftright("h", 56).alias("byte")).count().collect()):
        n += r["count"]
        if n >= SAMPLE_ROWS:
            last = r["byte"]
            break
    return rows.where(F.shiftright("h", 56) <= last).orderBy("h").limit(SAMPLE_ROWS).select("text", "lang")


def parts(spark, folder):
    """(record_type, record_id, lang stated, and the columns of label_parts) of all records.

    Garbled documents are dropped from the parts, which are smaller than the texts; none of them trains the field.
    """
    docs, seg, page, page_lang, bad = texts(spark, folder)
    seg, page = stash(seg), stash(page)
    rows = sample_of(docs.join(bad, "record_id", "left_anti")).unionByName(sample_of(seg)).unionByName(sample_of(page.withColumn("lang", F.lit(None).cast("string"))))
    field = train(sampled_sentences(rows.repartition(SAMPLE_TASKS)))
    key = ["record_type", "record_id"]
    out = [label_parts(x.withColumn("record_type", F.lit(t)), field, key, closed=t != "segment") for x, t in ((docs, "doc"), (seg, "segment"), (page, "page"))]
    out[0] = out[0].join(bad, "record_id", "left_anti").select(out[0].columns)
    own = [x.select(F.lit(t).alias("record_type"), "record_id", stated(F.col("lang")).alias("stated")) for x, t in ((docs, "doc"), (seg, "segment"), (page_lang, "page"))]
    return out, own


@LLM.add("p2_found")
def p2_found(spark, folder):
    out, own = parts(spark, folder)
    found = []
    for x, o in zip(out, own, strict=True):
        langs = x.where("full and lang <> 'other'").select("record_type", "record_id", "lang").distinct()
        found.append(langs.join(o, ["record_type", "record_id"], "left").where("stated is null or stated <> lang").select("record_type", "record_id", "lang"))
    return found[0].unionByName(found[1]).unionByName(found[2])


@LLM.add("p2_parts")
def p2_parts(spark, folder):
    """Each record's parts with language and confidence; parts of a page are those of its leaves."""
    out, _ = parts(spark, folder)
    x = out[0].unionByName(out[1]).unionByName(out[2])
    return x.withColumn("confidence", F.round("confidence", 3))
