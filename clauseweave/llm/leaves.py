"""Leaves of accessibility trees, shared by the page operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BLANK = r"(?U)^\s*$"


def is_text(c):
    """True where a name is neither null nor blank."""
    return c.isNotNull() & ~c.rlike(BLANK)


def leaves_of(nodes: DataFrame, *keep: str) -> DataFrame:
    """One row per leaf: a node without children whose name isn't null or blank.

    Repeated rows of a node count once (the least name, should they differ). Node rows and one
    marker per parent meet in a single aggregation by (page_id, node_id), so the names are
    shuffled once. ``keep`` names further columns to carry.
    """
    cols = ["name", *keep]
    own = nodes.select("page_id", "node_id", F.struct(*cols).alias("_r"), F.lit(False).alias("_inner"))
    up = nodes.where(F.col("parent_id").isNotNull()).select("page_id", F.col("parent_id").alias("node_id")).distinct()
    up = up.select("page_id", "node_id", F.lit(None).cast(own.schema["_r"].dataType).alias("_r"), F.lit(True).alias("_inner"))
    one = own.unionByName(up).groupBy("page_id", "node_id").agg(F.min("_r").alias("_r"), F.max("_inner").alias("_inner"))
    return one.where(~F.col("_inner") & F.col("_r").isNotNull() & is_text(F.col("_r.name"))).select("page_id", "node_id", *[F.col(f"_r.{c}") for c in cols])
