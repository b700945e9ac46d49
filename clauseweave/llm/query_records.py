"""Queries over records of entities: p4 (two sources), p6 (spellings) and p7 (groups)."""

from pyspark.sql import functions as F

from clauseweave.llm.components import contract
from clauseweave.llm.hosts import evidence_of, hosts_of
from clauseweave.llm.linkage import match_sources, reliability, score_pairs
from clauseweave.llm.names import name_families, resolve_names, same_records
from clauseweave.llm.queries import LLM
from clauseweave.plans.session import cut, table


@LLM.add(
    "p7_found",
    """WITH RECURSIVE pairs AS (SELECT left_id AS a, right_id AS b FROM entity_pairs WHERE is_match AND left_id IS NOT NULL AND right_id IS NOT NULL AND left_id <> right_id),
    ids AS (SELECT entity_id AS id FROM entity_info WHERE entity_id IS NOT NULL UNION SELECT left_id FROM entity_pairs WHERE left_id IS NOT NULL UNION SELECT right_id FROM entity_pairs WHERE right_id IS NOT NULL),
    links AS (SELECT DISTINCT a, b FROM pairs UNION SELECT b, a FROM pairs),
    reach AS (SELECT id, id AS other FROM ids UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
    SELECT id AS entity_id, min(other) AS group_id FROM reach GROUP BY id""",
)
def p7_found(spark, folder):
    pairs, info = table(spark, folder, "entity_pairs"), table(spark, folder, "entity_info")
    ids = info.select(F.col("entity_id").alias("id")).unionByName(pairs.select(F.explode(F.array("left_id", "right_id")).alias("id")))
    links = pairs.where(F.col("is_match")).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    every = ids.where("id is not null").distinct().join(contract(links), "id", "left")
    return every.select(F.col("id").alias("entity_id"), F.coalesce("group_id", "id").alias("group_id"))


def names_of(info):
    """(entity_id, name) of the name and of each alias of the records."""
    own = info.select("entity_id", "name")
    return own.unionByName(info.select("entity_id", F.explode("aliases").alias("name"))).where("name is not null")


def resolved(spark, folder):
    info = table(spark, folder, "entity_info")
    names = names_of(info)
    known = name_families(names)
    return resolve_names(names, evidence_of(info.select("entity_id", "domains"), known[1]), known)


@LLM.add("p6_found")
def p6_found(spark, folder):
    return same_records(resolved(spark, folder))


@LLM.add("p6_clusters")
def p6_clusters(spark, folder):
    """(entity_id, cluster_id): the least record of the same firm or person."""
    r = resolved(spark, folder)
    low = r.groupBy("family", "kind").agg(F.min("entity_id").alias("cluster_id"))
    ids = table(spark, folder, "entity_info").where("entity_id is not null").select("entity_id").distinct()
    return ids.join(r.join(low, ["family", "kind"]).select("entity_id", "cluster_id"), "entity_id", "left").select("entity_id", F.coalesce("cluster_id", "entity_id").alias("cluster_id"))


def sides(spark, folder):
    """(records, list entries, the four tables of ``score_pairs`` and its lent hosts) of both lists.

    Both lists' names go through ``resolve_names`` together, so that a record which doesn't state
    its trade or given name takes the kind that its family shows.
    """
    info = table(spark, folder, "entity_info").where("entity_id is not null")
    firm = table(spark, folder, "companies").where("permalink is not null").select("permalink", "name", "homepage_url").distinct()
    firm = firm.withColumn("rid", F.xxhash64(F.lit("c"), "permalink"))
    info = info.withColumn("lid", F.xxhash64(F.lit("e"), "entity_id"))
    own = names_of(info.drop("entity_id").withColumnRenamed("lid", "entity_id"))
    listed = firm.select(F.col("rid").alias("entity_id"), "name")
    site = firm.select(F.col("rid").alias("entity_id"), F.array("homepage_url").alias("domains"))
    names = own.unionByName(listed).where("name is not null")
    known = name_families(names)
    every = cut(hosts_of(info.select(F.col("lid").alias("entity_id"), "domains").unionByName(site), known[1]))
    hosts = every.where("not lent").select("entity_id", "token")
    kinds = cut(resolve_names(names, hosts, known).select(F.col("entity_id").alias("id"), "kind"))
    left = own.groupBy(F.col("entity_id").alias("lid")).agg(F.sort_array(F.collect_set("name")).alias("names"))
    third = info.groupBy("lid").agg(F.max("tracker_radar_entity").alias("third"))
    left = third.join(left, "lid", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    left = left.join(kinds.withColumnRenamed("id", "lid"), "lid", "left")
    right = firm.groupBy("rid").agg(F.max("name").alias("name")).join(kinds.withColumnRenamed("id", "rid"), "rid", "left")
    mine, its = info.select(F.col("lid").alias("entity_id")).distinct(), firm.select(F.col("rid").alias("entity_id")).distinct()
    side = lambda h, ids, k: h.join(ids, "entity_id").select(F.col("entity_id").alias(k), F.col("token").alias("host"))
    lent = every.where("lent")
    return info, firm, (left, right, side(hosts, mine, "lid"), side(hosts, its, "rid")), (side(lent, mine, "lid"), side(lent, its, "rid"))


def matches(spark, folder):
    """(entity_id, permalink, confidence) of the candidate pairs of both lists."""
    info, firm, tables, lent = sides(spark, folder)
    m = match_sources(*tables, lent=lent)
    m = m.join(info.select("lid", "entity_id").distinct(), "lid").join(firm.select("rid", "permalink").distinct(), "rid")
    return m.select("entity_id", "permalink", "confidence")


@LLM.add("p4_found")
def p4_found(spark, folder):
    return matches(spark, folder).where("confidence >= 0.5").select("entity_id", "permalink").distinct()


@LLM.add("p4_confidence")
def p4_confidence(spark, folder):
    return matches(spark, folder).where("confidence >= 0.05").withColumn("confidence", F.round("confidence", 3))


@LLM.add("p4_reliability")
def p4_reliability(spark, folder):
    """How far the confidences of names alone hold: predicted and observed share of common hosts, by tenths."""
    _, _, tables, lent = sides(spark, folder)
    return reliability(*score_pairs(*tables, lent=lent))
