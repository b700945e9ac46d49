"""Corpus analyses over policy graphs: flows, contradictions, summaries, definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clauseweave.operators import graph as G


def consistency(probes: DataFrame, plain: DataFrame, extended: DataFrame, unspecific: str = "third party") -> DataFrame:
    """Each probe (policy_id, entity, datatype) with two statuses (ANA-06, GQ-21..23).

    plain and extended: (policy_id, entity, datatype) disclosed in the graph and in the graph with the
    ontology. Collection asks whether anyone collects the type, entity whether the entity does, or,
    in the extended graph, an actor that the policy leaves unspecific.
    """
    flag = lambda d, name, *keys: d.select("policy_id", *keys).distinct().withColumn(name, F.lit(True))
    any_plain, any_ext = flag(plain, "p_any", "datatype"), flag(extended, "e_any", "datatype")
    own_plain, own_ext = flag(plain, "p_own", "entity", "datatype"), flag(extended, "e_own", "entity", "datatype")
    vague = flag(extended.where(F.col("entity") == unspecific), "e_vague", "datatype")
    j = probes.distinct()
    for d, keys in ((any_plain, ["policy_id", "datatype"]), (any_ext, ["policy_id", "datatype"]), (own_plain, ["policy_id", "entity", "datatype"]), (own_ext, ["policy_id", "entity", "datatype"]), (vague, ["policy_id", "datatype"])):
        j = j.join(d, keys, "left")
    return j.select(
        "policy_id", "entity", "datatype",
        F.when(F.col("p_any"), "clear").when(F.col("e_any"), "vague").otherwise("omitted").alias("collection_consistency"),
        F.when(F.col("p_own"), "clear").when(F.coalesce("e_own", "e_vague", F.lit(False)), "vague").otherwise("omitted").alias("entity_consistency"),
    )


def rollup_status(statuses: DataFrame, keys: list[str], status: str) -> DataFrame:
    """One status per key: omitted, partial, vague or clear (ANA-07)."""
    omitted, vague = F.bool_or(F.col(status) == "omitted"), F.bool_or(F.col(status) == "vague")
    others = F.bool_or(F.col(status) != "omitted")
    return statuses.groupBy(*keys).agg(F.when(omitted & ~others, "omitted").when(omitted, "partial").when(vague, "vague").otherwise("clear").alias("status"))


def row_percentages(counts: DataFrame, row: str, column: str, n: str = "n") -> DataFrame:
    """Counts with their share of the row (ANA-09, AGG-14)."""
    return counts.withColumn("pct", F.round(100.0 * F.col(n) / F.sum(n).over(Window.partitionBy(row)), 4))


def contradictions(edges: DataFrame, purposes: DataFrame, reach0: DataFrame) -> DataFrame:
    """(policy_id, action, pos_src, pos_dst, neg_src, neg_dst) of statements that contradict each other (ANA-11, ANA-20).

    A negative and a positive statement of one action conflict if the negative one names no purpose or
    a common one, and if both their entities and their data are equal or overlap in what lies below
    them without the positive one being the wider (which would be an exemption). purposes:
    (policy_id, src, dst, key, label); reach0: reflexive hypernymy (policy_id, src, dst).
    """
    c = G.collect_like(edges)
    labels = purposes.groupBy("policy_id", "src", "dst", "key").agg(F.collect_set("label").alias("labels"))
    c = c.join(labels, ["policy_id", "src", "dst", "key"], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>"))).withColumn("action", F.regexp_replace("key", "^NOT_", ""))
    pos = c.where(~F.col("key").startswith("NOT_")).select("policy_id", "action", F.col("src").alias("pos_src"), F.col("dst").alias("pos_dst"), F.col("labels").alias("pos_labels"))
    neg = c.where(F.col("key").startswith("NOT_")).select("policy_id", "action", F.col("src").alias("neg_src"), F.col("dst").alias("neg_dst"), F.col("labels").alias("neg_labels"))
    wider = reach0.where("src <> dst").select("policy_id", F.col("src").alias("a"), F.col("dst").alias("b"))

    def alike(p: str, n: str) -> DataFrame:
        """(policy_id, p, n): ends of a positive and a negative statement that overlap without the former being the wider."""
        a = reach0.select("policy_id", F.col("src").alias("a"), "dst").join(pos.select("policy_id", F.col(p).alias("a")).distinct(), ["policy_id", "a"], "left_semi")
        b = reach0.select("policy_id", F.col("src").alias("b"), "dst").join(neg.select("policy_id", F.col(n).alias("b")).distinct(), ["policy_id", "b"], "left_semi")
        both = a.join(b, ["policy_id", "dst"]).select("policy_id", "a", "b").distinct()
        return both.join(wider, ["policy_id", "a", "b"], "left_anti").withColumnsRenamed({"a": p, "b": n})

    both = pos.join(alike("pos_dst", "neg_dst"), ["policy_id", "pos_dst"]).join(neg, ["policy_id", "action", "neg_dst"])
    both = both.where((F.size("neg_labels") == 0) | F.arrays_overlap("pos_labels", "neg_labels")).join(alike("pos_src", "neg_src"), ["policy_id", "pos_src", "neg_src"], "left_semi")
    return both.select("policy_id", "action", "pos_src", "pos_dst", "neg_src", "neg_dst")


def misleading_definitions(reach: DataFrame, ontology: DataFrame, precise: DataFrame) -> DataFrame:
    """(policy_id, parent, child): SUBSUM paths between ontology terms that the ontology doesn't have (ANA-17).

    ontology: its closure (parent, child); precise: (node, is_precise) of its terms. The parent must be
    an imprecise term. The ontology is a constant of a few dozen terms, so it is broadcast.
    """
    vague = F.broadcast(precise.where("not is_precise").select(F.col("node").alias("parent")))
    known = F.broadcast(precise.select(F.col("node").alias("child")))
    r = reach.where("src <> dst").select("policy_id", F.col("src").alias("parent"), F.col("dst").alias("child"))
    return r.join(vague, "parent").join(known, "child").join(F.broadcast(ontology), ["parent", "child"], "left_anti").select("policy_id", "parent", "child").distinct()


def self_defined_terms(reach: DataFrame, uses: DataFrame, known: DataFrame, least_uses: int) -> DataFrame:
    """(term, def_count, use_count, meanings) of terms outside the ontology that policies define by it (ANA-18, AGG-09)."""
    terms = F.broadcast(known.select(F.col("node").alias("dst")))
    d = reach.where("src <> dst").join(terms, "dst").join(F.broadcast(known.select(F.col("node").alias("src"))), "src", "left_anti")
    d = d.groupBy(F.col("src").alias("term")).agg(F.countDistinct("policy_id").alias("def_count"), F.array_join(F.array_sort(F.collect_set("dst")), "|").alias("meanings"))
    u = uses.groupBy("term").agg(F.countDistinct("policy_id").alias("use_count")).where(F.col("use_count") > least_uses)
    return d.join(u, "term").select("term", "def_count", "use_count", "meanings")
