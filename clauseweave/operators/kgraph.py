"""Questions to policy graphs: who collects what, for which purposes, and where it says so."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from clauseweave.operators import graph as G
from clauseweave.plans.session import cut


class KGraph:
    """The graphs of a corpus, with their closure and node types computed once (OPT-06, OPT-13).

    edges: policy_id, src, dst, key, clean and distinct. Every method answers for all policies at
    once; a single question is a filter on its result, which Spark pushes below the joins.
    """

    def __init__(self, edges: DataFrame) -> None:
        self.edges = edges

    @cached_property
    def reach(self) -> DataFrame:
        """Reflexive hypernymy: (policy_id, src, dst, dist), src the wider term."""
        r = G.closure(self.edges.where("key = 'SUBSUM'"))
        nodes = self.edges.select("policy_id", F.explode(F.array("src", "dst")).alias("src")).distinct()
        return cut(r.where("src <> dst").unionByName(nodes.select("policy_id", "src", F.col("src").alias("dst"), F.lit(0).alias("dist"))))

    @cached_property
    def types(self) -> DataFrame:
        return cut(G.node_types(self.edges))

    @cached_property
    def flows(self) -> DataFrame:
        """(policy_id, entity, datatype, key, via_src, via_dst, dist): every way in which a collect-like edge covers a pair.

        An edge (e', d') covers each narrower entity below e' and each narrower data type below d'.
        """
        up = self.reach.select("policy_id", F.col("src").alias("via_src"), F.col("dst").alias("entity"), F.col("dist").alias("da"))
        down = self.reach.select("policy_id", F.col("src").alias("via_dst"), F.col("dst").alias("datatype"), F.col("dist").alias("dd"))
        c = G.collect_like(self.edges).select("policy_id", F.col("src").alias("via_src"), F.col("dst").alias("via_dst"), "key")
        actors = self.types.where("type = 'ACTOR'").select("policy_id", F.col("node").alias("entity"))
        data = self.types.where("type = 'DATA'").select("policy_id", F.col("node").alias("datatype"))
        j = c.join(up.join(actors, ["policy_id", "entity"], "left_semi"), ["policy_id", "via_src"]).join(down.join(data, ["policy_id", "datatype"], "left_semi"), ["policy_id", "via_dst"])
        return cut(j.select("policy_id", "entity", "datatype", "key", "via_src", "via_dst", (F.col("da") + F.col("dd") + 1).alias("dist")))

    @property
    def _positive(self) -> DataFrame:
        return self.flows.where(~F.col("key").startswith("NOT_"))

    def who_collect(self) -> DataFrame:
        """(policy_id, entity, datatype) for which the policy says that entity collects datatype."""
        return self._positive.select("policy_id", "entity", "datatype").distinct()

    def cannot_collect(self) -> DataFrame:
        """The same for negated statements."""
        return self.flows.where(F.col("key").startswith("NOT_")).select("policy_id", "entity", "datatype").distinct()

    def validate_collection(self) -> DataFrame:
        """(policy_id, datatype) that someone collects."""
        return self._positive.select("policy_id", "datatype").distinct()

    def validate_sharing(self, probes: DataFrame) -> DataFrame:
        """The probes (policy_id, entity, datatype) that the policy discloses."""
        return probes.join(self.who_collect(), ["policy_id", "entity", "datatype"], "left_semi")

    def subsum_pairs(self) -> DataFrame:
        """(policy_id, type, wide, narrow, dist) of nodes of one type, reflexive."""
        t = self.types
        r = self.reach.join(t.select("policy_id", F.col("node").alias("src"), "type"), ["policy_id", "src"]).join(t.select("policy_id", F.col("node").alias("dst"), F.col("type").alias("t2")), ["policy_id", "dst"])
        return r.where("type = t2").select("policy_id", "type", F.col("src").alias("wide"), F.col("dst").alias("narrow"), F.col("dist").cast("int").alias("dist"))

    def purposes(self, full: DataFrame) -> DataFrame:
        """(policy_id, entity, datatype, label): purposes on all shortest paths from entity to datatype."""
        p = self._positive
        best = p.groupBy("policy_id", "entity", "datatype").agg(F.min("dist").alias("dist"))
        said = full.select("policy_id", F.col("src").alias("via_src"), F.col("dst").alias("via_dst"), "key", F.explode("purposes").alias("p")).select("policy_id", "via_src", "via_dst", "key", F.col("p.label").alias("label")).distinct()
        return p.join(best, ["policy_id", "entity", "datatype", "dist"]).join(said, ["policy_id", "via_src", "via_dst", "key"]).select("policy_id", "entity", "datatype", "label").distinct()

    def evidence(self, full: DataFrame) -> DataFrame:
        """(policy_id, wide, narrow, text): sentences on the shortest SUBSUM paths between two terms.

        An edge is on one exactly if the distances to its ends and the edge add up to the whole.
        """
        r = self.reach
        whole = r.where("dist > 0").select("policy_id", F.col("src").alias("wide"), F.col("dst").alias("narrow"), "dist")
        e = full.where("key = 'SUBSUM'").select("policy_id", F.col("src").alias("u"), F.col("dst").alias("v"), F.explode("text").alias("sentence"))
        a = r.select("policy_id", F.col("src").alias("wide"), F.col("dst").alias("u"), F.col("dist").alias("d1"))
        b = r.select("policy_id", F.col("src").alias("v"), F.col("dst").alias("narrow"), F.col("dist").alias("d2"))
        j = e.join(a, ["policy_id", "u"]).join(b, ["policy_id", "v"]).join(whole, ["policy_id", "wide", "narrow"]).where("d1 + 1 + d2 = dist")
        return j.groupBy("policy_id", "wide", "narrow").agg(F.array_join(F.array_sort(F.collect_set("sentence")), "|").alias("text"))
