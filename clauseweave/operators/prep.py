"""Preparation of entity tables and training samples."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def merge_entities(a: DataFrame, b: DataFrame, key: str, sets: list[str]) -> DataFrame:
    """Full outer merge of two entity tables; array columns are united (PRE-06, AGG-11)."""
    both = a.select(key, *sets).unionByName(b.select(key, *sets))
    return both.groupBy(key).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in sets])


def ngrams(words: Column, most: int = 5) -> Column:
    """All runs of up to ``most`` words, joined by spaces (PRE-07)."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), n)
    return F.when(n > 0, F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), n - i + 1)), lambda k: F.array_join(F.slice(words, i, k), " ")))))).otherwise(F.array().cast("array<string>"))


def unique_ngrams(names: DataFrame, key: str, name: str) -> DataFrame:
    """(ngram, key) of the n-grams that one entity's names alone hold (PRE-08)."""
    g = names.select(key, F.explode(ngrams(F.filter(F.split(F.lower(F.trim(name)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))).alias("ngram")).distinct()
    return g.groupBy("ngram").agg(F.min(key).alias(key), F.max(key).alias("_m")).where(F.col(key) == F.col("_m")).drop("_m")


def follow_to_root(links: DataFrame, child: str, parent: str, rounds: int = 40) -> DataFrame:
    """(child, root): where links of one parent each lead, by pointer doubling (PRE-04). Loops end at their least member."""
    from clauseweave.plans.session import cut

    cur = cut(links.select(F.col(child).alias("c"), F.col(parent).alias("p"), F.least(F.col(child), F.col(parent)).alias("low")))
    for _ in range(min(rounds, cur.count().bit_length() + 1)):  # a chain is no longer than there are links
        up = cur.select(F.col("c").alias("p"), F.col("p").alias("p2"), F.col("low").alias("low2"))
        new = cut(cur.join(up, "p", "left").select("c", F.coalesce("p2", "p").alias("p"), F.least("low", F.coalesce("low2", "low")).alias("low"), F.col("p2").isNotNull().alias("moved")))
        if not new.where("moved").limit(1).count():
            break
        cur = new.drop("moved")
    loops = cur.join(links.select(F.col(child).alias("p")).distinct(), "p", "left_semi").select("c", F.lit(True).alias("loop"))
    return cur.join(loops, "c", "left").select(F.col("c").alias(child), F.when(F.col("loop"), F.col("low")).otherwise(F.col("p")).alias("root"))


SLOT = re.compile(r"%(\w+)%")
GROUP = re.compile(r"\(([^()]*)\)(\?)?|([\w-])\?")


def expand_template(template: str, aliases: dict[str, str] | None = None) -> list[str]:
    """All strings of a template of words, (a|b) groups, optional parts and %aliases%, in order (PRE-10)."""
    for name, text in (aliases or {}).items():
        template = template.replace(f"%{name}%", f"({text})")
    done, todo, seen = [], [template], set()
    while todo:
        t = todo.pop(0)
        m = GROUP.search(t)
        if not m:
            s = re.sub(r"\s+", " ", t).strip()
            if s not in seen:
                seen.add(s)
                done.append(s)
            continue
        options = m[1].split("|") if m[1] is not None else [m[3]]
        if m[2] or m[3]:
            options = [*options, ""]
        todo = [t[: m.start()] + o + t[m.end() :] for o in options] + todo
    return done


def expand_templates(df: DataFrame, template: str) -> DataFrame:
    """One row per string of each template; the templates stay, in Arrow batches."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: expand_template(t) if isinstance(t, str) else [])

    return df.withColumn("text", F.explode(F.pandas_udf(run, "array<string>")(template)))


def choose(requests: DataFrame, words: DataFrame, seed: int = 0, per_bucket: int = 64) -> DataFrame:
    """``requests`` (id, k, label) with a ``word`` of their label, drawn by hashes; labels without words give no row.

    words: label, word; any number. Words lie in buckets of about ``per_bucket`` by their hash; a request
    falls on one, and there on the word that comes first in its own hash order. So no list of all words is
    ever brought together, and the draw is the same for any partitioning.
    """
    w = words.where("label is not null and word is not null").distinct()
    sizes = w.groupBy("label").agg(F.greatest(F.lit(1), F.floor(F.count("*") / per_bucket)).cast("bigint").alias("n"))
    at = w.join(sizes, "label").select("label", "word", F.pmod(F.xxhash64("word"), F.col("n")).alias("b"))
    full = at.groupBy("label").agg(F.array_sort(F.collect_set("b")).alias("full"))  # numbers of the buckets that aren't empty
    r = requests.join(full, "label").withColumn("b", F.col("full")[F.pmod(F.xxhash64("id", "k", F.lit(seed)), F.size("full")).cast("int")])
    one = r.join(at, ["label", "b"]).groupBy("id", "k").agg(F.min(F.struct(F.xxhash64("word", "id", "k", F.lit(seed)).alias("h"), "word")).alias("c"))
    return one.select("id", "k", F.col("c.word").alias("word"))


def fill_slots(templates: DataFrame, words: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` sentences with filled %LABEL% slots and the spans of the fillings (PRE-11, PRE-21).

    templates: template; words: label, word. Templates and words are drawn by ``choose``. A slot whose label
    has no words takes the label in lower case.
    """
    spark = templates.sparkSession
    ids = spark.range(n).select("id", F.lit(-1).alias("k"), F.lit("").alias("label"))
    rows = choose(ids, templates.select(F.lit("").alias("label"), F.col("template").alias("word")), seed).select("id", F.col("word").alias("template"))
    labels = F.regexp_extract_all("template", F.lit(SLOT.pattern), 1)
    slots = rows.select("id", F.posexplode(labels).alias("k", "label"))
    got = choose(slots, words, seed).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "word"))).alias("w"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t, w in zip(b["id"], b["template"], b["w"], strict=True):
                w = dict(w) if w is not None else {}
                text, spans, at = "", [], 0
                for k, m in enumerate(SLOT.finditer(t)):
                    text += t[at : m.start()]
                    word = w.get(k, m[1].lower())
                    spans.append((len(text), len(text) + len(word), m[1]))
                    text += word
                    at = m.end()
                out.append((i, text + t[at:], spans))
            yield pd.DataFrame(out, columns=["id", "text", "spans"])

    return rows.join(got, "id", "left").mapInPandas(fill, "id bigint, text string, spans array<struct<start:int,end:int,label:string>>")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order; a deterministic dropDuplicates (AGG-10, PRE-13)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def label_vector(labels: Column, classes: list[str]) -> Column:
    """0/1 for each class (PRE-15)."""
    return F.array(*[F.array_contains(labels, c).cast("int") for c in classes])


def threshold_labels(scores: Column, high: float = 0.95, low: float = 0.60) -> Column:
    """Labels of (score, label) structs: all above ``high``; without any, the best if above ``low`` (NRM-08)."""
    best = F.sort_array(scores, asc=False)
    sure = F.filter(best, lambda s: s["score"] > high)
    return F.transform(F.when(F.size(sure) > 0, sure).otherwise(F.filter(F.slice(best, 1, 1), lambda s: s["score"] > low)), lambda s: s["label"])
