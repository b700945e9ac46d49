"""Consolidating pairwise matches into groups (problem 7) by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clauseweave.plans.session import cut

MAX_ROUNDS = 200
EXPANDED_AT_ONCE = 4  # mappings joined in one plan, so that plans stay small however many rounds there are


def contract(links: DataFrame, seed: int = 0) -> DataFrame:
    """(id, group_id) of each id that ``links`` (a, b) connect to another; group_id is the least id.

    In each round every vertex hooks to the vertex of its closed neighbourhood that comes first in
    a fresh hash order; edges are relabelled, loops and repeats dropped. The expected number of
    vertices shrinks by a constant factor whatever the shape, so stars, chains and giant components
    all end after about log(n) rounds. Then the rounds' mappings are expanded backwards.

    The choice per vertex is a minimum (combined before the shuffle), so a hub is no hot spot there;
    the relabelling joins are plain equi joins whose skewed keys adaptive execution splits. Links
    with a null end and self links connect nothing; repeats and both directions count once.
    """
    kind = links.schema["a"].dataType
    e = links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = cut(e)
    maps: list[DataFrame] = []
    for r in range(MAX_ROUNDS):
        if not e.limit(1).count():
            break
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed), F.lit(r)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = both.select("a", F.least(rank("a"), rank("b")).alias("r")).groupBy("a").agg(F.min("r").alias("r"))
        m = cut(m.select(F.col("a").alias("v"), F.col("r.v").alias("rep")))
        maps.append(m)
        e = e.join(m.select(F.col("v").alias("a"), F.col("rep").alias("ra")), "a").join(m.select(F.col("v").alias("b"), F.col("rep").alias("rb")), "b").where("ra <> rb")
        e = cut(e.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    if not maps:
        return links.sparkSession.createDataFrame([], f"id {kind.simpleString()}, group_id {kind.simpleString()}")
    label = maps[-1]
    for k, m in enumerate(reversed(maps[:-1]), 1):
        up = label.select(F.col("v").alias("rep"), F.col("rep").alias("top"))
        label = m.join(up, "rep", "left").select("v", F.coalesce("top", "rep").alias("rep"))
        label = label if k % EXPANDED_AT_ONCE else cut(label)
    label = cut(label)
    low = label.groupBy("rep").agg(F.min("v").alias("group_id"))
    return label.join(low, "rep").select(F.col("v").alias("id"), "group_id")


def group_records(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group_id) for every id of ``ids`` and of the ends of ``links``; unlinked ids stand alone."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id"))
    every = ids.select("id").unionByName(ends).where("id is not null").distinct()
    return every.join(contract(links), "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
