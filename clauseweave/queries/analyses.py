"""Flows, contradictions, summaries and definitions over the policy graphs."""

from pyspark.sql import functions as F

from clauseweave.operators import analyses as A, graph as G, ontology as O, policies as P
from clauseweave.operators.kgraph import KGraph
from clauseweave.plans.registry import CORE
from clauseweave.plans.session import cut, table
from clauseweave.queries.graphs import BASE, edges, graphs_of, subsum, who_collect
from clauseweave.queries.sqlparts import KG, KGE, REACH, TYPES

q = CORE.add
# The policies' own words: the last word of a term is its class, so classes stand in for an ontology of these terms.
CLASSES = "regexp_extract({0}, '([a-z]+)$', 1)"
PROBE_SQL = "probes AS (SELECT DISTINCT d.policy_id, 'we' AS entity, d.dst AS datatype FROM col d UNION SELECT DISTINCT s.policy_id, 'trusted partner', s.dst FROM sub s JOIN types t ON t.policy_id = s.policy_id AND t.node = s.dst AND t.type = 'DATA')"
PLAIN = "pos AS (SELECT DISTINCT policy_id, entity, datatype FROM who WHERE NOT starts_with(key, 'NOT_')), dir AS (SELECT DISTINCT policy_id, src AS entity, dst AS datatype FROM col WHERE NOT starts_with(key, 'NOT_'))"
STATUS = """st AS (SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM dir x WHERE x.policy_id = p.policy_id AND x.datatype = p.datatype) THEN 'clear' WHEN EXISTS (SELECT 1 FROM pos x WHERE x.policy_id = p.policy_id AND x.datatype = p.datatype) THEN 'vague' ELSE 'omitted' END AS collection_consistency,
    CASE WHEN EXISTS (SELECT 1 FROM dir x WHERE x.policy_id = p.policy_id AND x.datatype = p.datatype AND x.entity = p.entity) THEN 'clear' WHEN EXISTS (SELECT 1 FROM pos x WHERE x.policy_id = p.policy_id AND x.datatype = p.datatype AND x.entity IN (p.entity, 'third party')) THEN 'vague' ELSE 'omitted' END AS entity_consistency FROM probes p)"""
FLOW = f"{BASE}, {PROBE_SQL}, {PLAIN}, {STATUS}"


def statuses(spark, folder):
    return P.answers(table(spark, folder, "kg_edges"), P.Policy.consistency, "entity string, datatype string, collection_consistency string, entity_consistency string", joined_statuses)


def joined_statuses(kg):
    k = graphs_of(kg)
    e = k.edges
    c = G.collect_like(e)
    types = k.types
    data = subsum(e).select("policy_id", F.col("dst").alias("node")).join(types.where("type = 'DATA'"), ["policy_id", "node"], "left_semi")
    probes = c.select("policy_id", F.lit("we").alias("entity"), F.col("dst").alias("datatype")).unionByName(data.select("policy_id", F.lit("trusted partner").alias("entity"), F.col("node").alias("datatype"))).distinct()
    direct = c.where(~F.col("key").startswith("NOT_")).select("policy_id", F.col("src").alias("entity"), F.col("dst").alias("datatype"))
    return A.consistency(probes, direct, k.who_collect())


@q("flow_consistency", f"{FLOW} SELECT policy_id, entity, datatype, collection_consistency, entity_consistency FROM st")
def flow_consistency(spark, folder):
    """ANA-06, ANA-10, GQ-21..23, OPT-16: stated directly is clear, stated by a wider term is vague."""
    return statuses(spark, folder)


@q("consistency_rollup", f"{FLOW} SELECT policy_id, datatype, CASE WHEN bool_and(entity_consistency = 'omitted') THEN 'omitted' WHEN bool_or(entity_consistency = 'omitted') THEN 'partial' WHEN bool_or(entity_consistency = 'vague') THEN 'vague' ELSE 'clear' END AS status FROM st GROUP BY ALL")
def consistency_rollup(spark, folder):
    """ANA-07."""
    return A.rollup_status(statuses(spark, folder), ["policy_id", "datatype"], "entity_consistency")


@q("consistency_row_pct", f"{FLOW}, c AS (SELECT entity, entity_consistency AS status, count(*) AS n FROM st GROUP BY ALL) SELECT entity, status, n, round(100.0 * n / sum(n) OVER (PARTITION BY entity), 4) AS pct FROM c")
def consistency_row_pct(spark, folder):
    """ANA-08, ANA-09, AGG-14."""
    c = statuses(spark, folder).groupBy("entity", F.col("entity_consistency").alias("status")).agg(F.count("*").alias("n"))
    return A.row_percentages(c, "entity", "status")


@q("system_comparison", f"{FLOW} SELECT collection_consistency, count(*) FILTER (entity_consistency = 'clear') AS clear, count(*) FILTER (entity_consistency = 'vague') AS vague, count(*) FILTER (entity_consistency = 'omitted') AS omitted FROM st GROUP BY ALL")
def system_comparison(spark, folder):
    """ANA-08, AGG-12, AGG-13: a fixed, zero-filled matrix."""
    return statuses(spark, folder).groupBy("collection_consistency").pivot("entity_consistency", ["clear", "vague", "omitted"]).count().fillna(0)


@q("flow_first_seen", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_event, count(*) AS flows FROM events GROUP BY ALL")
def flow_first_seen(spark, folder):
    """ANA-01, AGG-08: the first flow of each kind wins."""
    return table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.count("*").alias("flows"))


@q("flow_domain_fill", "SELECT event_id, coalesce(d, last_value(d IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS domain FROM (SELECT *, CASE WHEN event_type = 'click' THEN NULL ELSE event_type || '.example' END AS d FROM events)")
def flow_domain_fill(spark, folder):
    """ANA-02: an unknown domain is the last known one of the same address."""
    from pyspark.sql import Window

    e = table(spark, folder, "events").withColumn("d", F.when(F.col("event_type") != "click", F.concat("event_type", F.lit(".example"))))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", F.coalesce("d", F.last("d", ignorenulls=True).over(w)).alias("domain"))


@q("flow_party", """WITH own AS (SELECT entity_id, min(lower(d)) AS domain FROM (SELECT entity_id, unnest(domains) AS d FROM entity_info) GROUP BY ALL), p AS (SELECT a.entity_id, a.domain, b.left_id, b.right_id FROM own a JOIN entity_pairs b ON b.left_id = a.entity_id)
    SELECT DISTINCT p.left_id, p.right_id, p.domain, CASE WHEN p.domain LIKE '%cloudnook%' THEN 'cloud' WHEN o.domain = p.domain THEN 'first' WHEN string_split(o.domain, '.')[1] = string_split(p.domain, '.')[1] THEN 'first' ELSE 'third' END AS party FROM p LEFT JOIN own o ON o.entity_id = p.right_id WHERE p.right_id IS NOT NULL""")
def flow_party(spark, folder):
    """ANA-03..05, JON-01, JON-02: cloud, first or third party by the owners' domains."""
    own = table(spark, folder, "entity_info").select("entity_id", F.explode("domains").alias("d")).groupBy("entity_id").agg(F.min(F.lower("d")).alias("domain"))
    p = table(spark, folder, "entity_pairs").select("left_id", "right_id").where("right_id is not null").join(own.withColumnRenamed("entity_id", "left_id"), "left_id")
    j = p.join(own.select(F.col("entity_id").alias("right_id"), F.col("domain").alias("other")), "right_id", "left")
    first = (F.col("other") == F.col("domain")) | (F.split("other", r"\.")[0] == F.split("domain", r"\.")[0])
    return j.select("left_id", "right_id", "domain", F.when(F.col("domain").contains("cloudnook"), "cloud").when(first, "first").otherwise("third").alias("party")).distinct()


@q("contradictions", f"""WITH RECURSIVE {KG}, {KGE}, {REACH}, c AS (SELECT c.*, regexp_replace(key, '^NOT_', '') AS action, coalesce(list(DISTINCT label) FILTER (label IS NOT NULL), []) AS labels FROM col c LEFT JOIN purp p USING (policy_id, src, dst, key) GROUP BY ALL),
    al AS (SELECT DISTINCT x.policy_id, x.src AS a, y.src AS b FROM reach0 x JOIN reach0 y ON y.policy_id = x.policy_id AND y.dst = x.dst WHERE NOT EXISTS (SELECT 1 FROM reach0 r WHERE r.policy_id = x.policy_id AND r.src = x.src AND r.dst = y.src AND r.src <> r.dst))
    SELECT p.policy_id, p.action, p.src AS pos_src, p.dst AS pos_dst, n.src AS neg_src, n.dst AS neg_dst FROM c p JOIN c n ON n.policy_id = p.policy_id AND n.action = p.action AND starts_with(n.key, 'NOT_') AND NOT starts_with(p.key, 'NOT_')
    WHERE (len(n.labels) = 0 OR list_has_any(n.labels, p.labels)) AND EXISTS (SELECT 1 FROM al WHERE al.policy_id = p.policy_id AND a = p.src AND b = n.src) AND EXISTS (SELECT 1 FROM al WHERE al.policy_id = p.policy_id AND a = p.dst AND b = n.dst)""")
def contradictions(spark, folder):
    """ANA-11, ANA-20, JON-07, SET-04."""
    full = cut(G.clean_edges(table(spark, folder, "kg_edges")))
    e = full.select("policy_id", "src", "dst", "key")
    said = full.select("policy_id", "src", "dst", "key", F.explode("purposes").alias("p")).select("policy_id", "src", "dst", "key", F.col("p.label").alias("label")).distinct()
    return A.contradictions(e, said, KGraph(e).reach)


@q("contradiction_labels", f"""WITH RECURSIVE {KG}, {KGE}, {REACH}, pn AS (SELECT p.policy_id, regexp_replace(p.key, '^NOT_', '') AS action, p.src AS ps, p.dst AS pd, n.src AS ns, n.dst AS nd, n.key AS nk, p.key AS pk FROM col p JOIN col n ON n.policy_id = p.policy_id AND starts_with(n.key, 'NOT_') AND NOT starts_with(p.key, 'NOT_') AND n.dst = p.dst),
    lab AS (SELECT pn.*, CASE WHEN nk <> 'NOT_' || pk THEN 'DIFF_ACTIONS' WHEN ps <> ns AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.policy_id = pn.policy_id AND (r.src = ps AND r.dst = ns OR r.src = ns AND r.dst = ps)) THEN 'DIFF_SUBJECTS'
        WHEN EXISTS (SELECT 1 FROM purp a WHERE a.policy_id = pn.policy_id AND a.src = ns AND a.dst = nd AND a.key = nk) AND NOT EXISTS (SELECT 1 FROM purp a JOIN purp b ON b.policy_id = a.policy_id AND b.label = a.label WHERE a.policy_id = pn.policy_id AND a.src = ns AND a.dst = nd AND a.key = nk AND b.src = ps AND b.dst = pd AND b.key = pk) THEN 'DIFF_PURPOSES'
        WHEN ps <> ns THEN 'ONTOLOGY' ELSE 'CONFLICT' END AS label FROM pn)
    SELECT label, count(*) AS n, count(DISTINCT policy_id) AS policies FROM lab GROUP BY ALL""")
def contradiction_labels(spark, folder):
    """ANA-12, ANA-13, SRT-04, SRT-05: why a pair of opposite statements is or isn't a conflict; the first reason counts."""
    full = cut(G.clean_edges(table(spark, folder, "kg_edges")))
    c = G.collect_like(full).withColumn("labels", F.array_distinct(F.transform("purposes", lambda p: p["label"]))).select("policy_id", "src", "dst", "key", "labels")
    p = c.where(~F.col("key").startswith("NOT_")).select("policy_id", "dst", F.col("src").alias("ps"), F.col("key").alias("pk"), F.col("labels").alias("pl"))
    n = c.where(F.col("key").startswith("NOT_")).select("policy_id", "dst", F.col("src").alias("ns"), F.col("key").alias("nk"), F.col("labels").alias("nl"))
    r = G.closure(subsum(full)).select("policy_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    tied = cut(r.unionByName(r.select("policy_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("tied", F.lit(True)))
    j = p.join(n, ["policy_id", "dst"]).join(tied.withColumnsRenamed({"a": "ps", "b": "ns"}), ["policy_id", "ps", "ns"], "left")
    label = F.when(F.col("nk") != F.concat(F.lit("NOT_"), "pk"), "DIFF_ACTIONS").when((F.col("ps") != F.col("ns")) & F.col("tied").isNull(), "DIFF_SUBJECTS").when((F.size("nl") > 0) & ~F.arrays_overlap("nl", "pl"), "DIFF_PURPOSES").when(F.col("ps") != F.col("ns"), "ONTOLOGY").otherwise("CONFLICT")
    return j.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.countDistinct("policy_id").alias("policies"))


CATS = "CASE WHEN {0} IN ('we', 'us') THEN 'first party' WHEN regexp_matches({0}, 'provider|vendor|processor|reseller') THEN 'service' WHEN regexp_matches({0}, 'advertis|analytics|network') THEN 'advertising' ELSE 'other' END"


def category(c):
    return F.when(c.isin("we", "us"), "first party").when(c.rlike("provider|vendor|processor|reseller"), "service").when(c.rlike("advertis|analytics|network"), "advertising").otherwise("other")


@q("summary_entity_matrix", f"{BASE}, s AS (SELECT {CLASSES.format('datatype')} AS data_class, {CATS.format('entity')} AS cat, policy_id FROM who WHERE NOT starts_with(key, 'NOT_')) SELECT data_class, " + ", ".join(f"count(DISTINCT policy_id) FILTER (cat = '{c}') AS \"{c}\"" for c in ("first party", "service", "advertising", "other")) + " FROM s GROUP BY ALL")
def summary_entity_matrix(spark, folder):
    """ANA-14, ANA-15, AGG-12, D19: how many policies let whom collect which class of data."""
    w = who_collect(spark, folder).select(F.regexp_extract("datatype", "([a-z]+)$", 1).alias("data_class"), category(F.col("entity")).alias("cat"), "policy_id").distinct()
    return w.groupBy("data_class").pivot("cat", ["first party", "service", "advertising", "other"]).agg(F.count("policy_id")).fillna(0)


@q("summary_purpose_matrix", f"WITH {KG}, {KGE}, s AS (SELECT DISTINCT {CLASSES.format('dst')} AS data_class, label, policy_id FROM purp) SELECT data_class, " + ", ".join(f"count(DISTINCT policy_id) FILTER (label = '{c}') AS {c}" for c in ("advertising", "analytics", "legal", "security", "services")) + " FROM s GROUP BY ALL")
def summary_purpose_matrix(spark, folder):
    """ANA-15, AGG-13."""
    f = G.clean_edges(table(spark, folder, "kg_edges")).select(F.regexp_extract("dst", "([a-z]+)$", 1).alias("data_class"), "policy_id", F.explode("purposes").alias("p")).select("data_class", "policy_id", F.col("p.label").alias("label")).distinct()
    return f.groupBy("data_class").pivot("label", ["advertising", "analytics", "legal", "security", "services"]).agg(F.count("policy_id")).fillna(0)


@q("summary_totals", f"WITH {KG}, {KGE} SELECT (SELECT count(DISTINCT policy_id) FROM kg) AS policies, (SELECT count(DISTINCT policy_id) FROM purp WHERE label IN ('advertising', 'analytics')) AS non_core, (SELECT count(DISTINCT policy_id) FROM purp WHERE label = 'advertising') AS advertising")
def summary_totals(spark, folder):
    """ANA-15, ANA-22, AGG-17: one pass, distinct policies per condition."""
    f = G.clean_edges(table(spark, folder, "kg_edges")).select("policy_id", F.explode_outer("purposes").alias("p"))
    return f.agg(F.countDistinct("policy_id").alias("policies"), F.countDistinct(F.when(F.col("p.label").isin("advertising", "analytics"), F.col("policy_id"))).alias("non_core"), F.countDistinct(F.when(F.col("p.label") == "advertising", F.col("policy_id"))).alias("advertising"))


@q("generic_term_sharing", f"""{BASE}, cov AS (SELECT r.policy_id, r.src AS term, count(DISTINCT {CLASSES.format('r.dst')}) AS classes FROM reach r JOIN types t ON t.policy_id = r.policy_id AND t.node = r.src AND t.type = 'DATA' GROUP BY ALL HAVING count(DISTINCT {CLASSES.format('r.dst')}) > 1)
    SELECT policy_id, min(term) AS term FROM cov WHERE EXISTS (SELECT 1 FROM who w WHERE w.policy_id = cov.policy_id AND w.datatype = cov.term AND NOT starts_with(w.key, 'NOT_') AND w.entity NOT IN ('we', 'us')) GROUP BY policy_id""")
def generic_term_sharing(spark, folder):
    """ANA-16, AGG-09, SRT-06: the first term over several classes that a third party collects."""
    return P.answers(table(spark, folder, "kg_edges"), P.Policy.generic_term, "term string", joined_generic_terms)


def joined_generic_terms(kg):
    k = graphs_of(kg)
    wide = G.closure(subsum(k.edges)).join(k.types.where("type = 'DATA'").select("policy_id", F.col("node").alias("src")), ["policy_id", "src"], "left_semi")
    wide = wide.groupBy("policy_id", F.col("src").alias("datatype")).agg(F.countDistinct(F.regexp_extract("dst", "([a-z]+)$", 1)).alias("n")).where("n > 1")
    third = k.who_collect().where(~F.col("entity").isin("we", "us"))
    return wide.join(third, ["policy_id", "datatype"], "left_semi").groupBy("policy_id").agg(F.min("datatype").alias("term"))


VAGUE = "regexp_matches({0}, ' (information|data|details)$')"


@q("misleading_definitions", f"WITH RECURSIVE {KG}, {REACH}, cls AS (SELECT DISTINCT policy_id, src AS parent, dst AS child FROM reach WHERE src <> dst AND {VAGUE.format('src')} AND NOT {VAGUE.format('dst')}) SELECT policy_id, parent, child FROM cls WHERE string_split(parent, ' ')[1] <> string_split(child, ' ')[1]")
def misleading_definitions(spark, folder):
    """ANA-17, ANA-21, JON-05: a vague term over a precise one of another field; the terms' first words are their fields."""
    e = edges(spark, folder)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    precise = nodes.select("node", (~F.col("node").rlike(" (information|data|details)$")).alias("is_precise"))
    r = G.closure(subsum(e)).where("src <> dst")
    same = r.select(F.col("src").alias("parent"), F.col("dst").alias("child")).where(F.split("parent", " ")[0] == F.split("child", " ")[0]).distinct()
    wide = precise.where("not is_precise").select(F.col("node").alias("parent"))
    fine = precise.where("is_precise").select(F.col("node").alias("child"))
    d = r.select("policy_id", F.col("src").alias("parent"), F.col("dst").alias("child"))
    return d.join(wide, "parent", "left_semi").join(fine, "child", "left_semi").join(same, ["parent", "child"], "left_anti").select("policy_id", "parent", "child").distinct()


@q("ontology_misleading", None)
def ontology_misleading(spark, folder):
    """ANA-17 with the data ontology itself; rows only where policies use its terms."""
    o, n = O.data_ontology(spark)
    known = G.closure(o.select(F.lit("o").alias("policy_id"), F.col("parent").alias("src"), F.col("child").alias("dst"))).select(F.col("src").alias("parent"), F.col("dst").alias("child"))
    return A.misleading_definitions(G.closure(subsum(edges(spark, folder))), known, n)


@q("misleading_topk", f"WITH RECURSIVE {KG}, {REACH}, m AS (SELECT DISTINCT policy_id, src AS parent, dst AS child FROM reach WHERE src <> dst AND {VAGUE.format('src')} AND NOT {VAGUE.format('dst')}) SELECT parent, child, count(*) AS n FROM m GROUP BY ALL ORDER BY n DESC, parent, child LIMIT 20")
def misleading_topk(spark, folder):
    """ANA-19, SRT-02: a top-k report."""
    r = G.closure(subsum(edges(spark, folder))).where("src <> dst")
    r = r.where(F.col("src").rlike(" (information|data|details)$") & ~F.col("dst").rlike(" (information|data|details)$"))
    return r.groupBy(F.col("src").alias("parent"), F.col("dst").alias("child")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "parent", "child").limit(20)


@q("self_defined_terms", f"WITH RECURSIVE {KG}, {REACH}, known AS (SELECT DISTINCT dst AS node FROM col), d AS (SELECT src AS term, count(DISTINCT policy_id) AS def_count, string_agg(DISTINCT dst, '|' ORDER BY dst) AS meanings FROM reach WHERE src <> dst AND dst IN (SELECT node FROM known) AND src NOT IN (SELECT node FROM known) GROUP BY src), u AS (SELECT node AS term, count(DISTINCT policy_id) AS use_count FROM ends GROUP BY ALL HAVING count(DISTINCT policy_id) > 1) SELECT term, def_count, use_count, meanings FROM d JOIN u USING (term)")
def self_defined_terms(spark, folder):
    """ANA-18, AGG-09, SET-01, SET-03."""
    e = edges(spark, folder)
    known = G.collect_like(e).select(F.col("dst").alias("node")).distinct()
    uses = e.select("policy_id", F.explode(F.array("src", "dst")).alias("term")).distinct()
    return A.self_defined_terms(G.closure(subsum(e)), uses, known, 1)


@q("extended_graph")
def extended_graph(spark, folder):
    """GQ-17, GQ-18, GQ-24, OPT-05: the graphs with the data ontology; tested on a small fixture."""
    o, n = O.data_ontology(spark)
    return O.extend_graph(edges(spark, folder), o, n)


@q("accept_unspecific", f"WITH RECURSIVE {KG}, {TYPES}, dt AS (SELECT policy_id, node FROM types WHERE type = 'DATA') SELECT policy_id, src, dst, key FROM col UNION SELECT c.policy_id, c.src, d.node, c.key FROM col c JOIN dt d ON d.policy_id = c.policy_id WHERE {VAGUE.format('c.dst')}")
def accept_unspecific(spark, folder):
    """GQ-19, GQ-20: an edge to an unspecific term counts for every data type of its policy."""
    return P.answers(table(spark, folder, "kg_edges"), P.Policy.accept_unspecific, "src string, dst string, key string", joined_unspecific)


def joined_unspecific(kg):
    e = cut(G.edges_of(kg))
    c = G.collect_like(e)
    mark = c.withColumn("dst", F.when(F.col("dst").rlike(" (information|data|details)$"), "UNSPECIFIED_DATA").otherwise(F.col("dst")))
    wide = O.accept_unspecific(mark, G.node_types(e).where("type = 'DATA'"))
    return wide.where("dst <> 'UNSPECIFIED_DATA'").unionByName(c).distinct()
