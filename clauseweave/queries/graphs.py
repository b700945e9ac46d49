"""Closure, graph algebra and the graph query interface over the policy graphs."""

from pyspark.sql import functions as F

from clauseweave.operators import graph as G, kgraph as K, policies as P
from clauseweave.plans.registry import CORE
from clauseweave.plans.session import cut, table
from clauseweave.queries.sqlparts import KG, KGE, REACH, TYPES


def edges(spark, folder):
    return cut(G.edges_of(table(spark, folder, "kg_edges")))


def graphs_of(kg):
    """The graphs of a table like kg_edges, by joins."""
    return K.KGraph(cut(G.edges_of(kg)))


def subsum(e):
    return e.where("key = 'SUBSUM'")


@CORE.add("reach_policy", f"WITH RECURSIVE {KG}, {REACH} SELECT policy_id, src, dst, dist::INT AS dist FROM reach")
def reach_policy(spark, folder):
    """GRA-01..04: hyponymy closure with shortest distances."""
    return G.closure(subsum(edges(spark, folder))).select("policy_id", "src", "dst", F.col("dist").cast("int").alias("dist"))


@CORE.add("node_types", f"WITH RECURSIVE {KG}, {TYPES} SELECT policy_id, node, type FROM types")
def node_types(spark, folder):
    """GQ-04, BLD-01, BLD-04."""
    return G.node_types(edges(spark, folder))


@CORE.add("flip_actor_edges", f"""WITH RECURSIVE {KG}, {TYPES} SELECT k.policy_id, CASE WHEN f THEN dst ELSE src END AS src, CASE WHEN f THEN src ELSE dst END AS dst, CASE WHEN f THEN 'SUBSUM_BY' ELSE key END AS key
    FROM (SELECT kg.*, key = 'SUBSUM' AND type = 'ACTOR' AS f FROM kg JOIN types t ON t.policy_id = kg.policy_id AND t.node = kg.src) k""")
def flip_actor_edges(spark, folder):
    """GQ-02."""
    e = edges(spark, folder)
    return G.flip_actor_edges(e, G.node_types(e))


@CORE.add("polarity_split", f"""WITH {KG} SELECT 'positive' AS polarity, * FROM kg WHERE NOT starts_with(key, 'NOT_') UNION ALL SELECT 'negative', * FROM kg WHERE key = 'SUBSUM' OR starts_with(key, 'NOT_')""")
def polarity_split(spark, folder):
    """GQ-03."""
    p, n = G.split_polarity(G.edges_of(table(spark, folder, "kg_edges")))
    return p.withColumn("polarity", F.lit("positive")).unionByName(n.withColumn("polarity", F.lit("negative")))


@CORE.add("merge_terms", f"""WITH {KG}, m AS (SELECT policy_id, CASE WHEN regexp_matches(src, ' (log|history|record)$') THEN regexp_replace(src, ' (log|history|record)$', ' data') ELSE src END AS src,
    CASE WHEN regexp_matches(dst, ' (log|history|record)$') THEN regexp_replace(dst, ' (log|history|record)$', ' data') ELSE dst END AS dst, key FROM kg) SELECT DISTINCT * FROM m WHERE src <> dst""")
def merge_terms(spark, folder):
    """GQ-01, BLD-07, GRA-07: terms contracted into one."""
    e = edges(spark, folder)
    pat = " (log|history|record)$"
    m = e.select("policy_id", F.explode(F.array("src", "dst")).alias("node")).distinct().where(F.col("node").rlike(pat)).withColumn("into", F.regexp_replace("node", pat, " data"))
    return G.rename_nodes(e, m)


@CORE.add("transitive_reduction", f"""WITH RECURSIVE {KG}, {REACH} SELECT s.policy_id, s.src, s.dst FROM sub s WHERE NOT EXISTS (SELECT 1 FROM sub x JOIN reach r ON r.policy_id = x.policy_id AND r.src = x.dst
    WHERE x.policy_id = s.policy_id AND x.src = s.src AND x.dst <> s.dst AND r.dst = s.dst)""")
def transitive_reduction(spark, folder):
    """BLD-08, GRA-06, OPT-01."""
    return G.transitive_reduction(subsum(edges(spark, folder)))


@CORE.add("acyclic_edges", f"""WITH RECURSIVE {KG}, {REACH} SELECT policy_id, src, dst FROM sub s WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.policy_id = s.policy_id AND r.src = s.dst AND r.dst = s.src)""")
def acyclic_edges(spark, folder):
    """BLD-05, BLD-14."""
    return G.acyclic(subsum(edges(spark, folder)))


@CORE.add("redundant_collect_prune", f"""WITH RECURSIVE {KG}, {KGE}, {REACH}, c AS (SELECT c.policy_id, c.src, c.dst, c.key, coalesce(list(DISTINCT label) FILTER (label IS NOT NULL), []) AS labels FROM col c LEFT JOIN purp p USING (policy_id, src, dst, key) GROUP BY ALL)
    SELECT policy_id, src, dst, key FROM c WHERE NOT EXISTS (SELECT 1 FROM c w JOIN reach r ON r.policy_id = w.policy_id AND r.src = w.dst
        WHERE w.policy_id = c.policy_id AND w.src = c.src AND w.key = c.key AND r.dst = c.dst AND w.dst <> c.dst AND list_has_all(w.labels, c.labels))""")
def redundant_collect_prune(spark, folder):
    """BLD-09, OPT-02, JON-08."""
    e = cut(G.clean_edges(table(spark, folder, "kg_edges")))
    c = G.collect_like(e).withColumn("labels", F.array_distinct(F.transform("purposes", lambda p: p["label"]))).select("policy_id", "src", "dst", "key", "labels")
    return G.prune_redundant(c, subsum(e)).select("policy_id", "src", "dst", "key")


@CORE.add("trim_graph", f"""WITH RECURSIVE {KG}, keep AS (SELECT policy_id, src AS node FROM col UNION SELECT policy_id, dst FROM col UNION SELECT k.policy_id, k.dst FROM keep JOIN kg k ON k.policy_id = keep.policy_id AND k.src = keep.node)
    SELECT kg.* FROM kg JOIN keep a ON a.policy_id = kg.policy_id AND a.node = src JOIN keep b ON b.policy_id = kg.policy_id AND b.node = dst""")
def trim_graph(spark, folder):
    """BLD-18, OPT-03."""
    return G.trim_graph(edges(spark, folder))


@CORE.add("drop_isolated", f"""WITH {KG}, deg AS (SELECT policy_id, node, count(*) AS degree FROM (SELECT policy_id, src AS node FROM kg WHERE src <> dst UNION ALL SELECT policy_id, dst FROM kg WHERE src <> dst) GROUP BY ALL) SELECT policy_id, node, degree FROM deg""")
def drop_isolated(spark, folder):
    """BLD-16, GRA-08."""
    d = G.degrees(G.edges_of(table(spark, folder, "kg_edges")).where("src <> dst"))
    return d.select("policy_id", "node", (F.col("in_degree") + F.col("out_degree")).alias("degree"))


@CORE.add("topo_depth", f"""WITH RECURSIVE {KG}, ends AS (SELECT policy_id, src AS node FROM sub UNION SELECT policy_id, dst FROM sub), {REACH.split('ends AS')[0].rstrip().rstrip(',')},
    bad AS (SELECT DISTINCT a.policy_id, b.dst AS node FROM reach a JOIN (SELECT * FROM reach UNION ALL SELECT policy_id, src, src, 0 FROM sub) b ON b.policy_id = a.policy_id AND b.src = a.src WHERE a.src = a.dst),
    lng AS (SELECT policy_id, dst AS node, max(dist) AS depth FROM walk GROUP BY ALL)
    SELECT e.policy_id, e.node, coalesce(depth, 0)::INT AS depth FROM ends e LEFT JOIN lng USING (policy_id, node) WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.policy_id = e.policy_id AND bad.node = e.node)""")
def topo_depth(spark, folder):
    """GRA-05, SRT-10."""
    return G.topological_depth(subsum(edges(spark, folder)))


@CORE.add("edge_text_dedup", f"""WITH {KGE} SELECT policy_id, src, dst, key, string_agg(sentence, '|' ORDER BY sentence) AS text FROM ev a
    WHERE NOT EXISTS (SELECT 1 FROM ev b WHERE b.policy_id = a.policy_id AND b.src = a.src AND b.dst = a.dst AND b.key = a.key AND length(b.sentence) > length(a.sentence) AND contains(b.sentence, a.sentence)) GROUP BY ALL""")
def edge_text_dedup(spark, folder):
    """BLD-17, TXT-08, SRT-03: evidence that a longer sentence holds is dropped."""
    e = G.clean_edges(table(spark, folder, "kg_edges")).where(F.size("text") > 0)
    return e.select("policy_id", "src", "dst", "key", F.array_join(F.array_sort(G.keep_longest_sentences("text")), "|").alias("text"))


@CORE.add("map_aggregate", f"""WITH {KGE}, l AS (SELECT policy_id, src, dst, key, label, string_agg(phrase, ',' ORDER BY phrase) AS phrases FROM purp GROUP BY ALL) SELECT policy_id, src, dst, key, string_agg(label || '=' || phrases, ';' ORDER BY label) AS purposes FROM l GROUP BY ALL""")
def map_aggregate(spark, folder):
    """BLD-15, AGG-04: purposes of all rows of an edge as one map."""
    e = G.clean_edges(table(spark, folder, "kg_edges")).where(F.size("purposes") > 0)
    labels = F.array_sort(F.array_distinct(F.transform("purposes", lambda p: p["label"])))
    said = F.transform(labels, lambda x: F.concat(x, F.lit("="), F.array_join(F.array_sort(F.transform(F.filter("purposes", lambda p: p["label"] == x), lambda p: p["phrase"])), ",")))
    return e.select("policy_id", "src", "dst", "key", F.array_join(said, ";").alias("purposes"))


WHO = """who AS (SELECT DISTINCT a.policy_id, a.dst AS entity, d.dst AS datatype, c.key, a.dist + 1 + d.dist AS dist, c.src AS via_src, c.dst AS via_dst FROM col c
        JOIN reach0 a ON a.policy_id = c.policy_id AND a.src = c.src JOIN reach0 d ON d.policy_id = c.policy_id AND d.src = c.dst
        JOIN types ta ON ta.policy_id = a.policy_id AND ta.node = a.dst AND ta.type = 'ACTOR' JOIN types td ON td.policy_id = d.policy_id AND td.node = d.dst AND td.type = 'DATA')"""
BASE = f"WITH RECURSIVE {KG}, {REACH}, {TYPES}, {WHO}"


@CORE.add("who_collect", f"{BASE} SELECT DISTINCT policy_id, entity, datatype FROM who WHERE NOT starts_with(key, 'NOT_')")
def who_collect(spark, folder):
    """GQ-05, GQ-07, GQ-16: entity is-a e' that collects d' that subsumes datatype."""
    return P.answers(table(spark, folder, "kg_edges"), P.Policy.who_collect, "entity string, datatype string", lambda kg: graphs_of(kg).who_collect())


@CORE.add("cannot_collect", f"{BASE} SELECT DISTINCT policy_id, entity, datatype FROM who WHERE starts_with(key, 'NOT_')")
def cannot_collect(spark, folder):
    """GQ-06."""
    return P.answers(table(spark, folder, "kg_edges"), P.Policy.cannot_collect, "entity string, datatype string", lambda kg: graphs_of(kg).cannot_collect())


@CORE.add("subsum_pairs", f"WITH RECURSIVE {KG}, {REACH}, {TYPES} SELECT r.policy_id, t.type, r.src AS wide, r.dst AS narrow, r.dist::INT AS dist FROM reach0 r JOIN types t ON t.policy_id = r.policy_id AND t.node = r.src JOIN types u ON u.policy_id = r.policy_id AND u.node = r.dst AND u.type = t.type")
def subsum_pairs(spark, folder):
    """GQ-08, GQ-09, GQ-10: reflexive hypernymy between nodes of one type."""
    return P.answers(table(spark, folder, "kg_edges"), P.Policy.subsum_pairs, "type string, wide string, narrow string, dist int", lambda kg: graphs_of(kg).subsum_pairs())


@CORE.add("validate_collection", f"{BASE} SELECT DISTINCT policy_id, datatype FROM who WHERE NOT starts_with(key, 'NOT_')")
def validate_collection(spark, folder):
    """GQ-15, JON-04, OPT-07: data types that someone collects."""
    return P.answers(table(spark, folder, "kg_edges"), P.Policy.validate_collection, "datatype string", lambda kg: graphs_of(kg).validate_collection())


@CORE.add("purposes_shortest", f"""WITH RECURSIVE {KG}, {KGE}, {REACH}, {TYPES}, {WHO}, best AS (SELECT policy_id, entity, datatype, min(dist) AS dist FROM who WHERE NOT starts_with(key, 'NOT_') GROUP BY ALL)
    SELECT DISTINCT w.policy_id, w.entity, w.datatype, p.label FROM who w JOIN best b USING (policy_id, entity, datatype, dist) JOIN purp p ON p.policy_id = w.policy_id AND p.src = w.via_src AND p.dst = w.via_dst AND p.key = w.key WHERE NOT starts_with(w.key, 'NOT_')""")
def purposes_shortest(spark, folder):
    """GQ-12, GQ-14, GRA-03: purposes on all shortest paths."""

    def joined(kg):
        full = cut(G.clean_edges(kg))
        return K.KGraph(full.select("policy_id", "src", "dst", "key")).purposes(full)

    return P.answers(table(spark, folder, "kg_edges"), P.Policy.purposes, "entity string, datatype string, label string", joined, labels=True)


@CORE.add("evidence_text", f"""WITH RECURSIVE {KG}, {KGE}, {REACH}, {TYPES}, t AS (SELECT r.policy_id, r.src AS wide, r.dst AS narrow, e.sentence FROM reach r JOIN sub s ON s.policy_id = r.policy_id
        JOIN reach0 a ON a.policy_id = r.policy_id AND a.src = r.src AND a.dst = s.src JOIN reach0 b ON b.policy_id = r.policy_id AND b.src = s.dst AND b.dst = r.dst
        JOIN ev e ON e.policy_id = r.policy_id AND e.src = s.src AND e.dst = s.dst AND e.key = 'SUBSUM' WHERE r.src <> r.dst AND a.dist + 1 + b.dist = r.dist)
    SELECT policy_id, wide, narrow, string_agg(DISTINCT sentence, '|' ORDER BY sentence) AS text FROM t GROUP BY ALL""")
def evidence_text(spark, folder):
    """GQ-11, GQ-13: evidence along the shortest paths."""
    full = cut(G.clean_edges(table(spark, folder, "kg_edges")))
    return K.KGraph(full.select("policy_id", "src", "dst", "key")).evidence(full)
