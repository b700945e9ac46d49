"""Queries over texts: p8 (containers), p9 (mixtures) and p10 (encodings)."""

from pyspark.sql import functions as F

from clauseweave.llm.encoding import garbled_ids, restore
from clauseweave.llm.mixing import blocks_for, draw, plan, source_key
from clauseweave.llm.packing import pack
from clauseweave.llm.queries import LLM
from clauseweave.llm.tokens import count_tokens
from clauseweave.plans.session import stash, table


def sized_documents(spark, folder):
    """(id, source, tokens) of all documents; whole texts are counted, once."""
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), source_key(F.col("source")).alias("source"), count_tokens(F.col("text")).alias("tokens"))
    return stash(d)


@LLM.add("p8_packing")
def p8_packing(spark, folder):
    """(limit_name, container_id, doc_id, piece, first_token, tokens) for each capacity."""
    sized = sized_documents(spark, folder)
    out = None
    for name, capacity in sorted((r[0], int(r[1])) for r in table(spark, folder, "pack_limits").select("limit_name", "capacity_tokens").dropna().distinct().collect()):
        x = pack(sized, capacity).select(F.lit(name).alias("limit_name"), "container_id", F.col("id").alias("doc_id"), "piece", "first_token", "tokens")
        out = x if out is None else out.unionByName(x)
    return out


@LLM.add("p8_fill")
def p8_fill(spark, folder):
    """Containers used for each capacity, against the least that any packing needs."""
    limits = table(spark, folder, "pack_limits").select("limit_name", "capacity_tokens").distinct()
    p = p8_packing(spark, folder).groupBy("limit_name", "container_id").agg(F.sum("tokens").alias("t"))
    p = p.groupBy("limit_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    p = p.join(F.broadcast(limits), "limit_name").withColumn("least", F.ceil(F.col("tokens") / F.col("capacity_tokens")))
    return p.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4))


def mixture(spark, folder):
    """(sized documents, temperature exponent, targets, drawn records)."""
    sized = sized_documents(spark, folder)
    # one row per listed source: bounded by the list of targets
    targets = [(r[0].strip().lower(), r[1], int(r[2] or 0)) for r in table(spark, folder, "mix_targets").select("source", "target_share", "max_repeats").where("source is not null").collect()]
    share, repeats = {s: t for s, t, _ in targets}, {s: m for s, _, m in targets}
    listed = sized.where(F.col("source").isin(list(share)))
    stats = listed.groupBy("source").agg(F.sum("tokens"), F.count("*")).collect()
    have = {r[0]: int(r[1] or 0) for r in stats}
    budget, exponent = plan(have, share, repeats)
    drawn = draw(listed, budget, have, blocks=blocks_for(max([r[2] for r in stats], default=0)))
    return sized, exponent, targets, drawn


@LLM.add("p9_draws")
def p9_draws(spark, folder):
    """The mixture itself: one row for each time that a document is drawn."""
    return mixture(spark, folder)[3].withColumnRenamed("id", "doc_id")


@LLM.add("p9_shares")
def p9_shares(spark, folder):
    """Per source: target and reached share, what it has, what was drawn, how often at most, and the exponent of the mix."""
    sized, exponent, targets, drawn = mixture(spark, folder)
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    have = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available_tokens"))
    each = drawn.groupBy("source", "id").agg(F.count("*").alias("times"), F.sum("tokens").alias("tokens"))
    got = each.groupBy("source").agg(F.sum("tokens").alias("drawn_tokens"), F.sum("times").alias("draws"), F.max("times").alias("most_repeats"))
    total = got.agg(F.sum("drawn_tokens").alias("total"))
    r = t.join(have, "source", "full").join(got, "source", "left").crossJoin(F.broadcast(total)).fillna(0, ["documents", "available_tokens", "drawn_tokens", "draws", "most_repeats"])
    limit = F.col("available_tokens") * F.col("max_repeats")
    state = F.when(F.col("target_share").isNull(), "unlisted").when(F.col("available_tokens") == 0, "empty").when(F.col("drawn_tokens") >= limit, "short").otherwise("met")
    return r.select("source", "target_share", F.round(F.col("drawn_tokens") / F.col("total"), 6).alias("reached_share"), "max_repeats", "most_repeats", "documents", "available_tokens", "drawn_tokens", "draws", state.alias("state"), F.lit(round(exponent, 6)).alias("exponent"))


@LLM.add("p10_found")
def p10_found(spark, folder):
    return garbled_ids(table(spark, folder, "documents").select("doc_id", "text"))


@LLM.add("p10_restored")
def p10_restored(spark, folder):
    return restore(table(spark, folder, "documents").select("doc_id", "text"))
