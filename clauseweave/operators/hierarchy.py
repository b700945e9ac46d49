"""Parent-child links to full hierarchies by pointer doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clauseweave.plans.session import cut

SEPARATOR = " > "


def clean_term(c: Column) -> Column:
    """Trimmed, inner white space collapsed to one space, lower case; blank becomes null."""
    t = F.lower(F.trim(F.regexp_replace(c, r"(?U)[\s ]+", " ")))
    return F.when(t != "", t)


def _tidy(df: DataFrame) -> DataFrame:
    """A union over as many partitions as a shuffle has, as unions of unions would double them each round."""
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def resolve_hierarchy(edges: DataFrame, group: Sequence[str], parent: str = "parent", child: str = "child") -> DataFrame:
    """Root, depth and path of each node of the forests in ``edges``.

    edges: one row per link, ``group`` columns (a forest for each), parent, child. Links with a null
    end or a null group are no links; repeated rows count once; other columns are ignored, whatever
    their names. A child with several parents hangs under the one that sorts first, so that the
    result has one row per node.

    Result: group columns, ``node``, ``root``, ``depth`` INT, ``path_nodes`` ARRAY (root first, node
    last). A node on a loop (a self link is one) or below one has root '', depth -1 and an empty
    array. No edges give no rows.

    Plan: a first doubling moves only (pointer, distance): in each round an unresolved node takes
    over its pointer's pointer, so after k rounds it has jumped 2^k links. What is unresolved after
    log2(nodes of the largest group) rounds hangs on a loop. Only then the paths are concatenated,
    by the same doubling over the loop-free nodes, so a loop never grows a path. All joins are equi
    joins on (group, node), so a group that holds a third of all rows is spread over all tasks.
    """
    g = [f"_g{i}" for i in range(len(group))]
    links = edges.select(*[F.col(c).alias(a) for c, a in zip(group, g, strict=True)], F.col(parent).alias("_p"), F.col(child).alias("_c"))
    links = links.dropna()
    up = links.groupBy(*g, "_c").agg(F.min("_p").alias("_p"))
    nodes = up.select(*g, F.col("_c").alias("_n"), "_p").unionByName(links.select(*g, F.col("_p").alias("_n"), F.lit(None).cast("string").alias("_p")))
    state = cut(nodes.groupBy(*g, "_n").agg(F.max("_p").alias("_a")).withColumn("_d", F.when(F.col("_a").isNotNull(), F.lit(1)).otherwise(F.lit(0))).withColumn("_done", F.col("_a").isNull()).withColumn("_a", F.coalesce("_a", "_n")).withColumn("_up", F.when(~F.col("_done"), F.col("_a"))))
    largest = state.groupBy(*g).count().agg(F.max("count")).first()[0] or 0
    jumps = 0
    while 2**jumps < largest + 1:
        other = state.select(*g, F.col("_n").alias("_a"), F.col("_a").alias("_a2"), F.col("_d").alias("_d2"), F.col("_done").alias("_done2"))
        todo = state.where(~F.col("_done")).join(other, [*g, "_a"], "left")
        step = todo.select(*g, "_n", F.coalesce("_a2", "_a").alias("_a"), (F.col("_d") + F.coalesce("_d2", F.lit(0))).alias("_d"), F.coalesce("_done2", F.lit(False)).alias("_done"), "_up")
        state = cut(_tidy(state.where("_done").unionByName(step)))
        jumps += 1
        if not state.where(~F.col("_done")).limit(1).count():
            break
    tree = state.where("_done")
    seg = tree.select(*g, "_n", F.when(F.col("_up").isNull(), F.array("_n")).otherwise(F.array("_up", "_n")).alias("_path"), F.col("_a").alias("_root"), "_d")
    seg = cut(seg)
    for k in range(jumps + 1):
        short = F.size("_path") < F.col("_d") + 1
        if k and not seg.where(short).limit(1).count():
            break
        other = seg.select(*g, F.col("_n").alias("_top"), F.col("_path").alias("_path2"))
        todo = seg.where(short).withColumn("_top", F.element_at("_path", 1)).join(other, [*g, "_top"])
        joined = F.concat(F.slice("_path2", F.lit(1), F.size("_path2") - 1), F.col("_path"))
        step = todo.select(*g, "_n", joined.alias("_path"), "_root", "_d")
        seg = cut(_tidy(seg.where(~short).unionByName(step)))
    good = seg.select(*g, F.col("_n").alias("node"), F.col("_root").alias("root"), F.col("_d").cast("int").alias("depth"), F.col("_path").alias("path_nodes"))
    bad = state.where(~F.col("_done")).select(*g, F.col("_n").alias("node"), F.lit("").alias("root"), F.lit(-1).alias("depth"), F.array().cast("array<string>").alias("path_nodes"))
    out = good.unionByName(bad)
    return out.select(*[F.col(a).alias(c) for c, a in zip(group, g, strict=True)], "node", "root", "depth", "path_nodes")


def descendants(resolved: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, ancestor, descendant, distance INT) of each resolved node below another.

    Read off the paths, so it needs no join and no shuffle; nodes on or below a loop have none.
    """
    up = resolved.where("depth > 0").select(*group, F.col("node").alias("descendant"), "depth", F.posexplode("path_nodes").alias("_i", "ancestor"))
    return up.where(F.col("_i") < F.col("depth")).select(*group, "ancestor", "descendant", (F.col("depth") - F.col("_i")).cast("int").alias("distance"))


def subsumption_edges(kg_edges: DataFrame) -> DataFrame:
    """(policy_id, parent, child) of the SUBSUM edges; ends and key cleaned, unusable edges left out."""
    e = kg_edges.select("policy_id", clean_term(F.col("source")).alias("parent"), clean_term(F.col("target")).alias("child"), clean_term(F.col("key")).alias("key"))
    return e.where((F.col("key") == "subsum") & F.col("parent").isNotNull() & F.col("child").isNotNull()).select("policy_id", "parent", "child")
