"""Page-level filters: duplicates, snapshots, redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def content_dedup(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, canonical_id, digest): the least key with the same text (DOC-07). Null texts have no row.

    Digests are grouped with a combining minimum and joined back, so a text that a third of all rows
    share makes no hot group.
    """
    d = df.where(F.col(text).isNotNull()).select(key, F.sha2(F.col(text), 256).alias("digest"))
    low = d.groupBy("digest").agg(F.min(key).alias("canonical_id"))
    return d.join(low, "digest").select(key, "canonical_id", "digest")


def meta_refresh_target(html: Column) -> Column:
    """The URL of a refresh instruction, '' without one (DOC-10)."""
    return F.regexp_extract(html, r'(?i)<meta[^>]*http-equiv=.?refresh.?[^>]*url=([^">]+)', 1)


def nearest_snapshot(df: DataFrame, group: str, at: str, reference: str, key: str) -> DataFrame:
    """The row of each group nearest in time to a date, the least key on ties (DOC-11)."""
    off = F.abs(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lit(reference).cast("timestamp")))
    return df.where(F.col(at).isNotNull()).groupBy(group).agg(F.min_by(key, F.struct(off.alias("off"), F.col(key).alias("k"))).alias(key))


def chase(links: DataFrame, start: str, to: str, most: int) -> DataFrame:
    """(start_id, final_id, hops): where a chain of at most ``most`` links leads (DOC-12)."""
    e = links.select(F.col(start).alias("_a"), F.col(to).alias("_b"))
    cur = e.select(F.col("_a").alias("start_id"), F.col("_b").alias("final_id"), F.lit(1).alias("hops"))
    for _ in range(most - 1):
        cur = cur.join(e.withColumnRenamed("_a", "final_id"), "final_id", "left").select("start_id", F.coalesce("_b", "final_id").alias("final_id"), (F.col("hops") + F.col("_b").isNotNull().cast("int")).alias("hops"))
    return cur
