"""Scans and sinks of the exchange formats: each query writes a table in a format, reads it back and returns its rows."""

from pyspark.sql import functions as F

from clauseweave.operators import graph as G, normalize as N, ontology as O
from clauseweave.plans.registry import CORE
from clauseweave.plans.session import scratch, table
from clauseweave.queries.graphs import edges
from clauseweave.queries.sqlparts import CLEAN, KG, KGE
from clauseweave.sources import graphs as X

q = CORE.add
RULE_ROWS = ", ".join(f"('{t}', '{y}', '{n}')" for t, y, n in N.sql_rules("DATA"))
ONT = ", ".join(f"('{p}', '{c}')" for p, cs in ((p.replace("'", "''"), [c.replace("'", "''") for c in cs]) for p, cs in O.DATA_TREE.items()) for c in cs)
ONT_NODES = ", ".join("('" + n.replace("'", "''") + f"', {n not in O.DATA_TREE and n not in O.ISOLATED})" for n in sorted({x for p, cs in O.DATA_TREE.items() for x in (p, *cs)} | set(O.ISOLATED)))
EDGES = "policy_id string, src string, dst string, key string"


@q("yaml_graph_scan", f"WITH {KG} SELECT * FROM kg")
def yaml_graph_scan(spark, folder):
    """SRC-03, SRC-12, SNK-02, GRA-10: one YAML graph per policy folder."""
    at = scratch(spark)
    X.yaml_links(edges(spark, folder)).repartition("policy_id").write.partitionBy("policy_id").text(at)
    return X.read_yaml_graphs(spark, f"{at}/*/*.txt").select("policy_id", "src", "dst", "key")


@q("graphml_ontology_scan", f"SELECT * FROM (VALUES {ONT}) t(parent, child)")
def graphml_ontology_scan(spark, folder):
    """SRC-04, SNK-03, GQ-24: the data ontology through GraphML; a constant."""
    at = scratch(spark)
    X.write_graphml_ontology(*O.data_ontology(spark), at)
    return X.read_graphml_ontology(spark, at)[0]


@q("entity_json_scan", "WITH a AS (SELECT entity, unnest(aliases) AS alias FROM entity_info), b AS (SELECT entity, string_agg(DISTINCT alias, '|' ORDER BY alias) AS aliases FROM a WHERE alias IS NOT NULL GROUP BY entity) SELECT e.entity, max(e.prevalence) AS prevalence, coalesce(any_value(b.aliases), '') AS aliases FROM entity_info e LEFT JOIN b ON b.entity = e.entity WHERE e.entity IS NOT NULL GROUP BY e.entity")
def entity_json_scan(spark, folder):
    """SRC-06, D15: maps from entity to record, some thousand to a file."""
    e = table(spark, folder, "entity_info").where("entity is not null")
    g = e.groupBy("entity").agg(F.max("prevalence").alias("prevalence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases"))
    at = scratch(spark)
    X.write_entity_info(g, at)
    return X.read_entity_info(spark, at).select("entity", "prevalence", F.array_join("aliases", "|").alias("aliases"))


@q("csv_header_scan", "SELECT DISTINCT permalink, coalesce(name, '') AS name, coalesce(category_list, '') AS category_list FROM companies WHERE permalink IS NOT NULL")
def csv_header_scan(spark, folder):
    """SRC-07, SNK-04."""
    at = scratch(spark)
    X.write_csv(table(spark, folder, "companies").where("permalink is not null").select("permalink", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("category_list", F.lit("")).alias("category_list")).distinct(), at)
    return X.read_table_csv(spark, at, "permalink string, name string, category_list string").fillna("")


@q("csv_flow_scan", "SELECT 'app.u' || user_id AS package_name, event_type AS data_type, props AS privacy_policy, count(*) AS n FROM events GROUP BY ALL")
def csv_flow_scan(spark, folder):
    """SRC-08, D16: flow records without header."""
    at = scratch(spark)
    e = table(spark, folder, "events").select(F.concat(F.lit("app.u"), "user_id").alias("package_name"), F.lit("app").alias("app_name"), F.lit("1.0").alias("version_name"), F.lit("1").alias("version_code"), F.col("event_type").alias("data_type"), F.lit("d.example").alias("dest_domain"), F.lit("192.0.2.1").alias("dest_ip"), F.lit("0").alias("arb_number"), F.col("props").alias("privacy_policy"))
    X.write_csv(e, at, header=False)
    return X.read_flows(spark, at).groupBy("package_name", "data_type", "privacy_policy").agg(F.count("*").alias("n"))


@q("jsonl_scan", "SELECT DISTINCT seg_uid, segment_type, text, len(tokens) AS n_tokens FROM segments")
def jsonl_scan(spark, folder):
    """SRC-09, SNK-06, D20."""
    at = scratch(spark)
    X.write_jsonl(table(spark, folder, "segments").select("seg_uid", "segment_type", "text", "tokens").distinct(), at)
    return X.read_jsonl(spark, at, "seg_uid bigint, segment_type string, text string, tokens array<string>").select("seg_uid", "segment_type", "text", F.size("tokens").cast("bigint").alias("n_tokens")).distinct()


@q("zip_jsonl_scan", "SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL")
def zip_jsonl_scan(spark, folder):
    """SRC-11: JSON lines inside zip archives, some hundred lines to an archive."""
    d = table(spark, folder, "documents").where("text is not null").select(F.concat(F.lit("part"), F.pmod(F.xxhash64("doc_id"), F.lit(4096))).alias("archive"), F.to_json(F.struct("doc_id", "text")).alias("line"))
    lines = X.unzip_jsonl(X.zip_jsonl(d))
    return lines.select(F.from_json("line", "doc_id bigint, text string").alias("r")).select("r.doc_id", F.length("r.text").cast("bigint").alias("n"))


@q("line_list_scan", r"SELECT line, count(*) AS n FROM (SELECT trim(homepage_url) AS line FROM companies WHERE homepage_url IS NOT NULL) WHERE line <> '' AND line NOT LIKE '#%' GROUP BY line")
def line_list_scan(spark, folder):
    """SRC-16."""
    at = scratch(spark)
    c = table(spark, folder, "companies").where("homepage_url is not null")
    c.select(F.concat("homepage_url", F.lit("\n# "), F.coalesce("permalink", F.lit("none")), F.lit("\n  "))).write.text(at)
    return X.read_lines(spark, at).groupBy("line").agg(F.count("*").alias("n"))


@q("rule_file_normalize", f"WITH p AS (SELECT DISTINCT {CLEAN.format('source')} AS phrase FROM kg_edges WHERE {CLEAN.format('source')} <> ''), r(term, yes, no) AS (VALUES {RULE_ROWS}) SELECT phrase, term FROM p JOIN r ON regexp_matches(phrase, yes) AND (no = '' OR NOT regexp_matches(phrase, no))")
def rule_file_normalize(spark, folder):
    """SRC-17, UDX-04, UDX-05: normal forms by rules from a YAML file."""
    at = scratch(spark)
    X.write_rules(spark, {"DATA": N.DATA_RULES}, at)
    rules = X.read_rules(spark, at)["DATA"]
    p = table(spark, folder, "kg_edges").select(G.clean_term(F.col("source")).alias("phrase")).where("phrase <> ''").distinct()
    return N.normalize(p, "phrase", "DATA", rules)


@q("response_origin", "SELECT DISTINCT permalink, homepage_url AS url FROM companies WHERE homepage_url IS NOT NULL AND homepage_url <> '' AND homepage_url NOT LIKE '%>%'")
def response_origin(spark, folder):
    """SRC-19: the original URL that a stored response's Link header names."""
    c = table(spark, folder, "companies").where("homepage_url is not null and homepage_url <> '' and homepage_url not like '%>%'").select("permalink", F.concat(F.lit('<http://archive.example/tm/>; rel="timemap", <'), "homepage_url", F.lit('>; rel="original", <http://archive.example/>; rel="timegate"')).alias("link"))
    return c.select("permalink", X.original_url(F.col("link")).alias("url")).distinct()


@q("matrix_csv", f"WITH {KG}, c AS (SELECT src, key, count(*) AS n FROM kg WHERE key IN ('COLLECT', 'USE', 'STORE') GROUP BY ALL), s AS (SELECT DISTINCT src FROM c), k(key) AS (VALUES ('COLLECT'), ('USE'), ('STORE')) SELECT s.src, k.key, coalesce(c.n, 0) AS n FROM s CROSS JOIN k LEFT JOIN c ON c.src = s.src AND c.key = k.key")
def matrix_csv(spark, folder):
    """SNK-05, AGG-12, AGG-13: a zero-filled matrix through CSV and back into rows."""
    at = scratch(spark)
    X.write_csv(edges(spark, folder).where("key in ('COLLECT', 'USE', 'STORE')").groupBy("src").pivot("key", ["COLLECT", "USE", "STORE"]).count().fillna(0), at)
    return X.read_table_csv(spark, at, "src string, COLLECT bigint, USE bigint, STORE bigint").unpivot("src", ["COLLECT", "USE", "STORE"], "key", "n")


@q("entity_match", r"""WITH RECURSIVE nm AS (SELECT DISTINCT name FROM companies WHERE trim(name) <> ''),
    dom AS (SELECT lower(trim(d)) AS key, min(entity) AS entity FROM (SELECT entity, unnest(domains) AS d FROM entity_info) WHERE d IS NOT NULL GROUP BY 1),
    byd AS (SELECT nm.name, dom.entity FROM nm JOIN dom ON dom.key = lower(trim(nm.name))),
    g0 AS (SELECT lower(trim(k)) AS key, entity, ngrams[k] AS oov FROM (SELECT entity, ngrams, unnest(map_keys(ngrams)) AS k FROM entity_info) WHERE trim(k) <> ''),
    g AS (SELECT key, min({'e': entity, 'o': oov}) AS r FROM g0 GROUP BY key),
    w AS (SELECT name, list_filter(regexp_split_to_array(name, '[^\p{L}\p{N}&''._-]+'), lambda x: x <> '') AS w FROM nm WHERE name NOT IN (SELECT name FROM byd)),
    r AS (SELECT name, i, j, array_to_string(w[i:j], ' ') AS surface FROM w, range(1, 200) a(i), range(1, 200) b(j) WHERE i <= j AND j <= len(w)),
    h AS (SELECT r.name, r.i, r.j, r.surface, g.r.e AS entity, coalesce(g.r.o, false) AS oov FROM r JOIN g ON g.key = lower(r.surface)),
    best AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.name = h.name AND o.i <= h.j AND o.j >= h.i AND (o.j - o.i > h.j - h.i OR (o.j - o.i = h.j - h.i AND o.i < h.i)))),
    al AS (SELECT DISTINCT entity, ' ' || array_to_string(list_filter(regexp_split_to_array(a, '[^\p{L}\p{N}&''._-]+'), lambda x: x <> ''), ' ') || ' ' AS alias FROM (SELECT entity, unnest(aliases) AS a FROM entity_info) WHERE a IS NOT NULL)
    SELECT name, entity FROM byd UNION SELECT name, entity FROM best WHERE oov UNION SELECT b.name, b.entity FROM best b JOIN al ON al.entity = b.entity AND contains(al.alias, ' ' || b.surface || ' ') WHERE NOT oov""")
def entity_match(spark, folder):
    """NRM-04..06: company names through domains, n-grams and the rule for words of the vocabulary."""
    e = table(spark, folder, "entity_info").where("entity is not null").select("entity", "aliases", "domains", "ngrams")
    return N.match_entities(table(spark, folder, "companies").select("name"), e)


NORMAL = f"""terms AS (SELECT src AS phrase FROM kg UNION SELECT dst FROM kg), r(term, yes, no) AS (VALUES {RULE_ROWS}),
    nf AS (SELECT phrase, term FROM terms JOIN r ON regexp_matches(phrase, yes) AND (no = '' OR NOT regexp_matches(phrase, no)) WHERE term <> 'UNSPECIFIED'),
    nm AS (SELECT t.phrase, coalesce(nf.term, t.phrase) AS name FROM terms t LEFT JOIN nf ON nf.phrase = t.phrase),
    kgn AS (SELECT DISTINCT policy_id, a.name AS src, b.name AS dst, key FROM kg JOIN nm a ON a.phrase = src JOIN nm b ON b.phrase = dst WHERE a.name <> b.name)"""


def normal_edges(spark, folder):
    """The edges with each term replaced by its normal forms, where it has any."""
    e = edges(spark, folder)
    phrases = e.select(F.explode(F.array("src", "dst")).alias("phrase")).distinct()
    forms = F.array_remove(N.normal_forms(F.col("phrase"), "DATA"), "UNSPECIFIED")
    m = phrases.select("phrase", F.explode(F.when(F.size(forms) > 0, forms).otherwise(F.array("phrase"))).alias("name"))
    for c in ("src", "dst"):
        e = e.join(m.select(F.col("phrase").alias(c), F.col("name").alias(f"{c}_n")), c).drop(c).withColumnRenamed(f"{c}_n", c)
    return e.where("src <> dst").select("policy_id", "src", "dst", "key").distinct()


@q("normalized_graph", f"WITH {KG}, {NORMAL} SELECT * FROM kgn")
def normalized_graph(spark, folder):
    """BLD-10, NRM-02, NRM-03: the graphs over normal forms."""
    return normal_edges(spark, folder)


@q("ontology_definitions", f"""WITH RECURSIVE {KG}, {NORMAL}, ont(parent, child) AS (VALUES {ONT}), node(node, is_precise) AS (VALUES {ONT_NODES}),
    up AS (SELECT parent, child FROM ont UNION SELECT up.parent, ont.child FROM up JOIN ont ON ont.parent = up.child),
    s AS (SELECT DISTINCT policy_id, src, dst FROM kgn WHERE key = 'SUBSUM'), walk AS (SELECT policy_id, src, dst FROM s UNION SELECT w.policy_id, w.src, s.dst FROM walk w JOIN s ON s.policy_id = w.policy_id AND s.src = w.dst)
    SELECT DISTINCT policy_id, src AS parent, dst AS child FROM walk JOIN node a ON a.node = src AND NOT a.is_precise JOIN node b ON b.node = dst WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM up WHERE up.parent = src AND up.child = dst)""")
def ontology_definitions(spark, folder):
    """ANA-17, ANA-21, GQ-24: definitions over normal forms that the data ontology doesn't have."""
    from clauseweave.operators.analyses import misleading_definitions

    o, n = O.data_ontology(spark)
    known = G.closure(o.select(F.lit("o").alias("policy_id"), F.col("parent").alias("src"), F.col("child").alias("dst"))).select(F.col("src").alias("parent"), F.col("dst").alias("child"))
    return misleading_definitions(G.closure(normal_edges(spark, folder).where("key = 'SUBSUM'")), known, n)


@q("ontology_extended", f"""WITH {KG}, ont(parent, child) AS (VALUES {ONT}), node(node, is_precise) AS (VALUES {ONT_NODES}), have AS (SELECT policy_id, src AS node FROM kg UNION SELECT policy_id, dst FROM kg)
    SELECT policy_id, src, dst, key FROM kg UNION SELECT p.policy_id, parent, child, 'SUBSUM' FROM (SELECT DISTINCT policy_id FROM kg) p CROSS JOIN ont JOIN node ON node.node = child WHERE NOT is_precise
    UNION SELECT h.policy_id, parent, child, 'SUBSUM' FROM have h JOIN ont ON ont.child = h.node JOIN node ON node.node = child WHERE is_precise""")
def ontology_extended(spark, folder):
    """GQ-17, GQ-18, GQ-24, OPT-05: the graphs with the data ontology, against SQL."""
    o, n = O.data_ontology(spark)
    return O.extend_graph(edges(spark, folder), o, n)


@q("hypernym_paths", f"""WITH RECURSIVE {KG}, p AS (SELECT policy_id, dst AS node, src AS top, [dst, src] AS path FROM sub WHERE src <> dst UNION ALL SELECT p.policy_id, p.node, s.src, list_append(p.path, s.src) FROM p JOIN sub s ON s.policy_id = p.policy_id AND s.dst = p.top WHERE NOT list_contains(p.path, s.src)),
    b AS (SELECT policy_id, node, top, min({{'n': len(path), 'p': array_to_string(path, ' < ')}}) AS r FROM p GROUP BY ALL) SELECT policy_id, node, top, (r.n - 1)::INT AS dist, r.p AS path FROM b""")
def hypernym_paths(spark, folder):
    """GQ-25: for each term and hypernym the first of the shortest paths up."""
    return G.shortest_paths(edges(spark, folder).where("key = 'SUBSUM'"))


@q("precise_ancestors", f"""WITH RECURSIVE {KG}, {NORMAL}, node(node, is_precise) AS (VALUES {ONT_NODES}), s AS (SELECT DISTINCT policy_id, src, dst FROM kgn WHERE key = 'SUBSUM'),
    walk AS (SELECT policy_id, src, dst FROM s UNION SELECT w.policy_id, w.src, s.dst FROM walk w JOIN s ON s.policy_id = w.policy_id AND s.src = w.dst)
    SELECT policy_id, dst AS node, string_agg(DISTINCT src, '|' ORDER BY src) AS ancestors FROM walk JOIN node ON node.node = dst AND is_precise WHERE src <> dst GROUP BY ALL""")
def precise_ancestors(spark, folder):
    """GQ-26: all ancestors of each precise term."""
    n = O.data_ontology(spark)[1].where("is_precise").select(F.col("node").alias("dst"))
    r = G.closure(normal_edges(spark, folder).where("key = 'SUBSUM'")).where("src <> dst").join(F.broadcast(n), "dst", "left_semi")
    return r.groupBy("policy_id", F.col("dst").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("src")), "|").alias("ancestors"))


@q("dag_edges")
def dag_edges(spark, folder):
    """BLD-05: SUBSUM edges in order of their ends, without each that closes a loop; tested against an edge-by-edge build."""
    return G.without_closing_edges(edges(spark, folder).where("key = 'SUBSUM'"))


@q("purpose_labels", "WITH p AS (SELECT DISTINCT unnest(purposes[label]) AS phrase FROM (SELECT *, unnest(map_keys(purposes)) AS label FROM kg_edges)) SELECT phrase, " + " || ".join(f"CASE WHEN regexp_matches(lower(phrase), '{p}') THEN '{k}|' ELSE '' END" for k, p in N.PURPOSE_WORDS.items()) + " AS labels FROM p WHERE phrase IS NOT NULL")
def purpose_labels(spark, folder):
    """NRM-07, UDX-07, OPT-08: distinct purposes through the pluggable model."""
    k = table(spark, folder, "kg_edges").select(F.explode("purposes").alias("label", "phrases")).select(F.explode("phrases").alias("phrase")).where("phrase is not null").distinct()
    return k.select("phrase", F.array_join(F.transform(N.classify_purpose(F.col("phrase")), lambda x: F.concat(x, F.lit("|"))), "").alias("labels"))


@q("evidence_median", f"WITH {KG}, e AS (SELECT policy_id, upper({CLEAN.format('key')}) AS key, len(text) AS n FROM kg_edges WHERE text IS NOT NULL AND policy_id IS NOT NULL AND {CLEAN.format('key')} <> '') SELECT key, median(n) AS typical FROM e GROUP BY key")
def evidence_median(spark, folder):
    """UDX-08: a user's aggregate, here the median number of evidence sentences by kind of edge; partial counts come first."""
    e = table(spark, folder, "kg_edges").where("text is not null and policy_id is not null").select(F.upper(G.clean_term(F.col("key"))).alias("key"), F.size("text").alias("n")).where("key <> ''")
    return G.fold(e.groupBy("key", "n").agg(F.count("*").alias("c")), ["key"], lambda g: float(g["n"].repeat(g["c"]).median()), "typical double")

# SQL twins of older queries, made of the parts above.
CORE.oracles["extended_graph"] = CORE.oracles["ontology_extended"]
CORE.oracles["ontology_misleading"] = f"""WITH RECURSIVE {KG}, ont(parent, child) AS (VALUES {ONT}), node(node, is_precise) AS (VALUES {ONT_NODES}),
    up AS (SELECT parent, child FROM ont UNION SELECT up.parent, ont.child FROM up JOIN ont ON ont.parent = up.child),
    walk AS (SELECT policy_id, src, dst FROM sub UNION SELECT w.policy_id, w.src, s.dst FROM walk w JOIN sub s ON s.policy_id = w.policy_id AND s.src = w.dst)
    SELECT DISTINCT policy_id, src AS parent, dst AS child FROM walk JOIN node a ON a.node = src AND NOT a.is_precise JOIN node b ON b.node = dst WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM up WHERE up.parent = src AND up.child = dst)"""
CORE.oracles["purpose_classes"] = f"WITH {KG}, {KGE}, p AS (SELECT DISTINCT phrase FROM purp WHERE phrase IS NOT NULL) SELECT phrase, rtrim(" + " || ".join(f"CASE WHEN regexp_matches(lower(phrase), '{p}') THEN '{k}|' ELSE '' END" for k, p in N.PURPOSE_WORDS.items()) + ", '|') AS labels FROM p"
CORE.oracles["template_expand"] = r"""WITH t AS (SELECT DISTINCT trim(target) AS x FROM kg_edges WHERE target IS NOT NULL), w(a, b) AS (VALUES ('your', 'data'), ('your', 'information'), ('your', ''), ('the', 'data'), ('the', 'information'), ('the', ''))
    SELECT DISTINCT '(your|the) ' || x || ' (data|information)?' AS template, trim(regexp_replace(a || ' ' || x || ' ' || b, '\s+', ' ', 'g')) AS text FROM t CROSS JOIN w"""
