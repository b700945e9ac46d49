"""Policy graphs: cleaning, closure, reduction, pruning, contraction and trimming.

A corpus of graphs is two tables keyed by ``policy_id``. Edges are (policy_id, src, dst, key); every
operation is a join or an aggregation on keys that start with the policy and a node, so a policy that
holds a large part of all edges is spread over all tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from clauseweave.operators.hierarchy import clean_term
from clauseweave.plans.session import cut

POSITIVE = ["COLLECT", "BE_SHARED", "BE_SOLD", "USE", "STORE"]
NEGATIVE = [f"NOT_{k}" for k in POSITIVE]


def clean_edges(kg: DataFrame) -> DataFrame:
    """(policy_id, src, dst, key, text, purposes): one row per edge, evidence merged (D12, AGG-03, AGG-04).

    Ends are trimmed, inner space collapsed, lower case; keys upper case. Edges with a null or blank
    end, key or policy are left out. text is the sorted set of all evidence, purposes a sorted array
    of (label, phrase).
    """
    e = kg.select("policy_id", clean_term(F.col("source")).alias("src"), clean_term(F.col("target")).alias("dst"), F.upper(clean_term(F.col("key"))).alias("key"), "text", "purposes")
    e = e.dropna(subset=["policy_id", "src", "dst", "key"])
    said = F.flatten(F.transform(F.map_entries("purposes"), lambda m: F.transform(m["value"], lambda p: F.struct(m["key"].alias("label"), p.alias("phrase")))))
    e = e.withColumn("p", F.coalesce(said, F.array().cast("array<struct<label:string,phrase:string>>"))).withColumn("text", F.coalesce("text", F.array().cast("array<string>")))
    return e.groupBy("policy_id", "src", "dst", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("text")))).alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))).alias("purposes"))


def edges_of(kg: DataFrame) -> DataFrame:
    """(policy_id, src, dst, key) of the clean edges, without their evidence."""
    e = kg.select("policy_id", clean_term(F.col("source")).alias("src"), clean_term(F.col("target")).alias("dst"), F.upper(clean_term(F.col("key"))).alias("key"))
    return e.dropna().distinct()


def collect_like(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("key").isin(POSITIVE + NEGATIVE))


def closure(edges: DataFrame, group: str = "policy_id", reflexive: bool = False, rounds: int = 40) -> DataFrame:
    """(group, src, dst, dist): all pairs that a path connects, with the length of the shortest (GRA-01..04).

    Distance doubling: a round joins the pairs found so far with themselves, so after k rounds paths
    of up to 2^k edges are covered and log(diameter) rounds suffice; loops do no harm. Repeated
    edges count once, rows with a null are left out. A node reaches itself only over a loop, or,
    if ``reflexive``, at distance 0.
    """
    e = edges.select(F.col(group).alias("_g"), "src", "dst").dropna().distinct()
    r = cut(e.withColumn("dist", F.lit(1)))
    n, total = r.agg(F.count("*"), F.sum("dist")).first()
    for _ in range(rounds):
        a = r.select("_g", "src", F.col("dst").alias("mid"), F.col("dist").alias("d1"))
        b = r.select("_g", F.col("src").alias("mid"), "dst", F.col("dist").alias("d2"))
        step = a.join(b, ["_g", "mid"]).select("_g", "src", "dst", (F.col("d1") + F.col("d2")).alias("dist"))
        new = cut(r.unionByName(step).groupBy("_g", "src", "dst").agg(F.min("dist").alias("dist")))
        s = new.agg(F.count("*"), F.sum("dist")).first()
        if s[0] == n and s[1] == total:
            break
        r, n, total = new, s[0], s[1]
    if reflexive:
        nodes = e.select("_g", F.explode(F.array("src", "dst")).alias("src")).distinct()
        r = r.where("src <> dst").unionByName(nodes.select("_g", "src", F.col("src").alias("dst"), F.lit(0).alias("dist")))
    return r.select(F.col("_g").alias(group), "src", "dst", "dist")


def shortest_paths(edges: DataFrame) -> DataFrame:
    """(policy_id, node, top, dist, path): for each node and each above it the shortest path up, the first by its text (GQ-25).

    By doubling, as ``closure``: the first of the shortest paths is made of such paths. path joins the
    terms from the node to the top by ' < '.
    """
    e = edges.select("policy_id", F.col("dst").alias("node"), F.col("src").alias("top")).dropna().where("node <> top").distinct()
    r = cut(e.select("policy_id", "node", "top", F.struct(F.lit(1).alias("dist"), F.array("node", "top").alias("path")).alias("r")))
    before = None
    while (now := r.agg(F.count("*"), F.sum("r.dist")).first()) != before:
        before = now
        a = r.select("policy_id", "node", F.col("top").alias("mid"), F.col("r").alias("r1"))
        b = r.select("policy_id", F.col("node").alias("mid"), "top", F.col("r").alias("r2"))
        step = a.join(b, ["policy_id", "mid"]).where("node <> top").select("policy_id", "node", "top", F.struct((F.col("r1.dist") + F.col("r2.dist")).alias("dist"), F.concat("r1.path", F.slice("r2.path", 2, 1_000_000)).alias("path")).alias("r"))
        r = cut(r.unionByName(step).groupBy("policy_id", "node", "top").agg(F.min("r").alias("r")))
    return r.select("policy_id", "node", "top", F.col("r.dist").cast("int").alias("dist"), F.array_join("r.path", " < ").alias("path"))


def fold(df: DataFrame, keys: list[str], f, out: str) -> DataFrame:
    """A user's aggregate: ``f`` of the pandas rows of each key (UDX-08). Rows should be combined before, as a key's rows meet in one task."""
    name = out.split()[0]
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + out
    return df.groupBy(*keys).applyInPandas(lambda key, g: pd.DataFrame([(*key, f(g))], columns=[*keys, name]), schema)


def node_types(edges: DataFrame) -> DataFrame:
    """(policy_id, node, type): ACTOR for sources of collect-like edges and what SUBSUM ties to them, else DATA (D12, BLD-01, BLD-04)."""
    sub = edges.where("key = 'SUBSUM'")
    both = sub.select("policy_id", "src", "dst").unionByName(sub.select("policy_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    c = collect_like(edges)
    seeds = c.select("policy_id", F.col("src").alias("node")).distinct()
    tied = closure(both).join(seeds.withColumnRenamed("node", "src"), ["policy_id", "src"]).select("policy_id", F.col("dst").alias("node"))
    actors = seeds.unionByName(tied).distinct().withColumn("type", F.lit("ACTOR"))
    nodes = edges.select("policy_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(actors, ["policy_id", "node"], "left").select("policy_id", "node", F.coalesce("type", F.lit("DATA")).alias("type"))


def split_polarity(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positive, negative) views: SUBSUM edges are in both (GQ-03)."""
    return edges.where(~F.col("key").startswith("NOT_")), edges.where(F.col("key").isin("SUBSUM", "SUBSUM_BY") | F.col("key").startswith("NOT_"))


def flip_actor_edges(edges: DataFrame, types: DataFrame) -> DataFrame:
    """SUBSUM between actors turned into SUBSUM_BY from the narrower to the wider (GQ-02)."""
    t = types.select("policy_id", F.col("node").alias("src"), "type")
    flip = (F.col("key") == "SUBSUM") & (F.col("type") == "ACTOR")
    j = edges.join(t, ["policy_id", "src"], "left")
    return j.select("policy_id", F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("dst"), F.when(flip, "SUBSUM_BY").otherwise(F.col("key")).alias("key"))


def rename_nodes(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Nodes contracted into others by ``mapping`` (policy_id, node, into); loops go, repeats count once (BLD-07, GQ-01)."""
    m = lambda c: mapping.select("policy_id", F.col("node").alias(c), F.col("into").alias(f"{c}_to"))
    j = edges.join(m("src"), ["policy_id", "src"], "left").join(m("dst"), ["policy_id", "dst"], "left")
    j = j.select("policy_id", F.coalesce("src_to", "src").alias("src"), F.coalesce("dst_to", "dst").alias("dst"), "key")
    return j.where("src <> dst").distinct()


def transitive_reduction(edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """The edges of a DAG that no longer path replaces (BLD-08, GRA-06). reach: their ``closure``, where it is known."""
    e = edges.select("policy_id", "src", "dst").distinct()
    far = (closure(e) if reach is None else reach).select("policy_id", F.col("src").alias("mid"), "dst")
    longer = e.withColumnRenamed("dst", "mid").join(far, ["policy_id", "mid"]).where("mid <> dst").select("policy_id", "src", "dst").distinct()
    return e.join(longer, ["policy_id", "src", "dst"], "left_anti")


def acyclic(edges: DataFrame) -> DataFrame:
    """The edges that lie on no loop (BLD-05 without order: an edge goes if its source can be reached from its target)."""
    e = edges.select("policy_id", "src", "dst").distinct()
    back = closure(e).select("policy_id", F.col("src").alias("dst"), F.col("dst").alias("src"))
    return e.where("src <> dst").join(back, ["policy_id", "src", "dst"], "left_anti")


def without_closing_edges(edges: DataFrame, rank: list[str] | None = None) -> DataFrame:
    """The edges that remain if they are added in order of ``rank`` (their ends, unless given) and each that would close a loop is left out (BLD-05).

    Only edges on loops need an order. In each round the least greatest rank of any path is found for all
    pairs of their nodes, by doubling: an undecided edge whose way back always needs a later edge stays; one
    with a way back over earlier edges that stay goes. The first undecided edge of each policy is decided in
    each round, and usually all are. Self loops go, repeats count once, by their first.
    """
    order = F.struct(*(rank or ["src", "dst"])).alias("rank")
    e = edges.select("policy_id", "src", "dst", order).dropna(subset=["policy_id", "src", "dst"]).where("src <> dst").groupBy("policy_id", "src", "dst").agg(F.min("rank").alias("rank"))
    e = cut(e)
    back = closure(e).select("policy_id", F.col("src").alias("dst"), F.col("dst").alias("src"))
    open_ = cut(e.join(back, ["policy_id", "src", "dst"], "left_semi"))
    kept = e.join(open_, ["policy_id", "src", "dst"], "left_anti")
    if not open_.limit(1).count():
        return e.select("policy_id", "src", "dst")
    stay = open_.limit(0)
    while open_.limit(1).count():
        fits = _no_way_back(open_, _least_greatest(stay.unionByName(open_)))
        sure = cut(stay.unionByName(fits))
        open_ = open_.join(fits, ["policy_id", "src", "dst"], "left_anti")
        open_, stay = cut(_no_way_back(open_, _least_greatest(sure))), sure
    return kept.unionByName(stay).select("policy_id", "src", "dst")


def dag_with_reach(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``without_closing_edges`` of edges (policy_id, src, dst) and the ``closure`` of what remains; one closure where there are no loops."""
    e = cut(edges.select("policy_id", "src", "dst").dropna().where("src <> dst").distinct())
    reach = closure(e)
    if not reach.where("src = dst").limit(1).count():
        return e, reach
    kept = cut(without_closing_edges(e))
    return kept, closure(kept)


def _least_greatest(edges: DataFrame) -> DataFrame:
    """(policy_id, src, dst, rank): for each pair that a path connects, the least rank that its dearest edge can have."""
    r, before = cut(edges.groupBy("policy_id", "src", "dst").agg(F.min("rank").alias("rank"))), None
    while True:
        now = r.agg(F.count("*"), F.sum(F.xxhash64("src", "dst", "rank").cast("decimal(30,0)"))).first()
        if now == before:
            return r
        before = now
        a = r.select("policy_id", "src", F.col("dst").alias("mid"), F.col("rank").alias("r1"))
        b = r.select("policy_id", F.col("src").alias("mid"), "dst", F.col("rank").alias("r2"))
        step = a.join(b, ["policy_id", "mid"]).select("policy_id", "src", "dst", F.greatest("r1", "r2").alias("rank"))
        r = cut(r.unionByName(step).groupBy("policy_id", "src", "dst").agg(F.min("rank").alias("rank")))


def _no_way_back(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """The edges without a path from their target to their source over lower ranks only."""
    p = paths.select("policy_id", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("rank").alias("way"))
    bad = edges.join(p, ["policy_id", "src", "dst"]).where("way < rank").select("policy_id", "src", "dst")
    return cut(edges.join(bad, ["policy_id", "src", "dst"], "left_anti"))


def prune_redundant(collects: DataFrame, subsum: DataFrame) -> DataFrame:
    """Collect edges whose data term lies below one that the same actor has with at least its purposes (BLD-09).

    collects: policy_id, src, dst, key, labels ARRAY. Of two edges of a pair, the wider term's stays.
    """
    r = closure(subsum).select("policy_id", F.col("src").alias("wide"), F.col("dst").alias("narrow"))
    a = collects.select("policy_id", "src", "key", F.col("dst").alias("wide"), F.col("labels").alias("l1"))
    b = collects.select("policy_id", "src", "key", F.col("dst").alias("narrow"), F.col("labels").alias("l2"))
    gone = b.join(r, ["policy_id", "narrow"]).join(a, ["policy_id", "src", "key", "wide"]).where((F.size(F.array_except("l2", "l1")) == 0) & (F.col("wide") != F.col("narrow")))
    return collects.join(gone.select("policy_id", "src", "key", F.col("narrow").alias("dst")).distinct(), ["policy_id", "src", "key", "dst"], "left_anti")


def trim_graph(edges: DataFrame) -> DataFrame:
    """The edges between nodes that are ends of collect-like edges or reachable from one (BLD-18, OPT-03)."""
    seeds = collect_like(edges).select("policy_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    down = closure(edges).join(seeds.withColumnRenamed("node", "src"), ["policy_id", "src"]).select("policy_id", F.col("dst").alias("node"))
    keep = cut(seeds.unionByName(down).distinct())
    return edges.join(keep.withColumnRenamed("node", "src"), ["policy_id", "src"], "left_semi").join(keep.withColumnRenamed("node", "dst"), ["policy_id", "dst"], "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(policy_id, node, in_degree, out_degree) (GRA-08)."""
    x = edges.select("policy_id", F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select("policy_id", F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return x.groupBy("policy_id", "node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def topological_depth(edges: DataFrame) -> DataFrame:
    """(policy_id, node, depth): length of the longest path that ends at a node of a DAG (GRA-05, SRT-10).

    By doubling: the longest way over at most 2^k edges between two nodes is the longest of two ways over
    half as many, so the logarithm of the depth bounds the rounds. Nodes on a loop or below one have no
    depth and are left out first.
    """
    e = edges.select("policy_id", "src", "dst").dropna().distinct()
    near = closure(e)
    loops = near.where("src = dst").select("policy_id", F.col("src").alias("node"))
    lost = cut(loops.unionByName(near.join(loops.withColumnRenamed("node", "src"), ["policy_id", "src"], "left_semi").select("policy_id", F.col("dst").alias("node"))).distinct())
    e = e.join(lost.withColumnRenamed("node", "dst"), ["policy_id", "dst"], "left_anti")
    r = cut(e.join(lost.withColumnRenamed("node", "src"), ["policy_id", "src"], "left_anti").withColumn("dist", F.lit(1)))
    before = None
    while (now := r.agg(F.count("*"), F.sum("dist")).first()) != before:
        before = now
        a = r.select("policy_id", "src", F.col("dst").alias("mid"), F.col("dist").alias("d1"))
        b = r.select("policy_id", F.col("src").alias("mid"), "dst", F.col("dist").alias("d2"))
        step = a.join(b, ["policy_id", "mid"]).select("policy_id", "src", "dst", (F.col("d1") + F.col("d2")).alias("dist"))
        r = cut(r.unionByName(step).groupBy("policy_id", "src", "dst").agg(F.max("dist").alias("dist")))
    nodes = edges.select("policy_id", F.explode(F.array("src", "dst")).alias("node")).dropna().distinct().join(lost, ["policy_id", "node"], "left_anti")
    deep = r.groupBy("policy_id", F.col("dst").alias("node")).agg(F.max("dist").alias("depth"))
    return nodes.join(deep, ["policy_id", "node"], "left").select("policy_id", "node", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))


def keep_longest_sentences(text):
    """Evidence without the sentences that a longer one holds (BLD-17, SRT-03)."""
    return F.filter(text, lambda x: ~F.exists(text, lambda y: (F.length(y) > F.length(x)) & F.contains(y, x)))
