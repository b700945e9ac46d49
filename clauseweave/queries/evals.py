"""Evaluation and preparation queries."""

from pyspark.sql import functions as F

from clauseweave.operators import evals as V, graph as G, prep as P
from clauseweave.plans.registry import CORE
from clauseweave.plans.session import table
from clauseweave.queries.graphs import edges, subsum
from clauseweave.queries.sqlparts import KG, KGE, REACH

q = CORE.add
PR = "WITH t AS (SELECT left_id, right_id, max(matched_on) AS matched_on, max(CASE WHEN is_match THEN 1 ELSE 0 END) AS y FROM entity_pairs WHERE left_id IS NOT NULL AND right_id IS NOT NULL GROUP BY ALL), f AS (SELECT DISTINCT left_id, right_id FROM entity_pairs WHERE score >= 0.7 AND left_id IS NOT NULL AND right_id IS NOT NULL)"


@q("precision_recall_groups", f"""{PR}, j AS (SELECT t.matched_on, y, f.left_id IS NOT NULL AS f FROM t FULL JOIN f USING (left_id, right_id)), g AS (SELECT coalesce(matched_on, 'none') AS grp, f, y FROM j UNION ALL SELECT 'all', f, y FROM j)
    SELECT grp, count(*) FILTER (f AND y = 1) AS tp, count(*) FILTER (f AND coalesce(y, 0) = 0) AS fp, count(*) FILTER (NOT f AND y = 1) AS fn, round(count(*) FILTER (f AND y = 1) / nullif(count(*) FILTER (f), 0), 6) AS prec, round(count(*) FILTER (f AND y = 1) / nullif(count(*) FILTER (y = 1), 0), 6) AS recall FROM g GROUP BY grp""")
def precision_recall_groups(spark, folder):
    """EVL-01, EVL-02, EVL-03, AGG-05, JON-03."""
    p = table(spark, folder, "entity_pairs").where("left_id is not null and right_id is not null")
    truth = p.groupBy("left_id", "right_id").agg(F.max("matched_on").alias("matched_on"), F.max(F.coalesce(F.col("is_match"), F.lit(False)).cast("int")).alias("y"))
    found = p.where("score >= 0.7").select("left_id", "right_id").distinct().withColumn("f", F.lit(True))
    j = truth.join(found, ["left_id", "right_id"], "left").select(F.struct("left_id", "right_id").alias("pair"), "matched_on", "y", "f")
    return V.precision_recall(j.select("pair", "matched_on", "y"), j.where("f").select("pair"), ["pair"], "y", "matched_on")


ML = f"WITH {KG}, {KGE}, a AS (SELECT policy_id, list(DISTINCT label) AS y FROM purp WHERE key = 'COLLECT' GROUP BY ALL), b AS (SELECT policy_id, list(DISTINCT label) AS p FROM purp WHERE key = 'USE' GROUP BY ALL), m AS (SELECT coalesce(y, []) AS y, coalesce(p, []) AS p FROM a FULL JOIN b USING (policy_id)), e AS (SELECT DISTINCT row_number() OVER () AS r, y, p FROM m), l AS (SELECT r, y, p, unnest(list_distinct(y || p)) AS label FROM e)"


@q("multilabel_metrics", f"""{ML}, s AS (SELECT label, count(*) FILTER (list_contains(y, label) AND list_contains(p, label)) AS tp, count(*) FILTER (list_contains(p, label)) AS np, count(*) FILTER (list_contains(y, label)) AS support FROM l GROUP BY label),
    x AS (SELECT label, coalesce(tp / nullif(np, 0), 0.0) AS prec, coalesce(tp / nullif(support, 0), 0.0) AS recall, support FROM s), f AS (SELECT *, coalesce(2 * prec * recall / nullif(prec + recall, 0.0), 0.0) AS f1 FROM x)
    SELECT label, round(prec, 6) AS prec, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f UNION ALL SELECT 'macro', round(avg(prec), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f""")
def multilabel_metrics(spark, folder):
    """EVL-11, AGG-16: purposes of USE statements against those of COLLECT statements."""
    f = G.clean_edges(table(spark, folder, "kg_edges")).select("policy_id", "key", F.explode("purposes").alias("p"))
    m = f.groupBy("policy_id").agg(F.collect_set(F.when(F.col("key") == "COLLECT", F.col("p.label"))).alias("y"), F.collect_set(F.when(F.col("key") == "USE", F.col("p.label"))).alias("p"))
    return V.multilabel_metrics(m.where(F.size("y") + F.size("p") > 0), "y", "p")


@q("edge_stats", f"WITH {KG}, {KGE} SELECT (SELECT count(DISTINCT policy_id) FROM kg) AS graphs, (SELECT count(*) FROM kg) AS edges, (SELECT count(DISTINCT sentence) FROM ev) AS sentences, (SELECT count(*) FROM (SELECT DISTINCT policy_id, src, dst, key FROM purp)) AS with_purposes")
def edge_stats(spark, folder):
    """EVL-09, AGG-01, AGG-02."""
    f = G.clean_edges(table(spark, folder, "kg_edges"))
    n = f.agg(F.countDistinct("policy_id").alias("graphs"), F.count("*").alias("edges"), F.count_if(F.size("purposes") > 0).alias("with_purposes"))
    return n.crossJoin(f.select(F.explode("text").alias("s")).agg(F.countDistinct("s").alias("sentences")))


@q("edge_freq", f"WITH {KG} SELECT src, dst, key, count(*) AS n FROM kg GROUP BY ALL")
def edge_freq(spark, folder):
    """EVL-09, SRT-02: in how many policies each edge occurs."""
    return G.edges_of(table(spark, folder, "kg_edges")).groupBy("src", "dst", "key").agg(F.count("*").alias("n"))


@q("edge_pivot", f"WITH {KG} SELECT src, " + ", ".join(f"count(*) FILTER (key = '{k}') AS {k.lower()}" for k in ("COLLECT", "USE", "STORE")) + " FROM kg WHERE key IN ('COLLECT', 'USE', 'STORE') GROUP BY src")
def edge_pivot(spark, folder):
    """EVL-10, AGG-12."""
    e = G.edges_of(table(spark, folder, "kg_edges")).withColumn("k", F.lower("key")).where("k in ('collect', 'use', 'store')")
    return e.groupBy("src").pivot("k", ["collect", "use", "store"]).count().fillna(0)


@q("edge_transposed", f"WITH {KG}, p AS (SELECT key, count(*) AS n, count(DISTINCT policy_id) AS policies FROM kg GROUP BY key) SELECT key, 'n' AS metric, n AS amount FROM p UNION ALL SELECT key, 'policies', policies FROM p")
def edge_transposed(spark, folder):
    """AGG-15, SNK-08: counts turned into rows for plotting."""
    p = G.edges_of(table(spark, folder, "kg_edges")).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("policy_id").alias("policies"))
    return p.unpivot("key", ["n", "policies"], "metric", "amount")


@q("stratified_sample", f"WITH {KG} SELECT policy_id, src, dst, key FROM kg QUALIFY row_number() OVER (PARTITION BY policy_id ORDER BY md5(concat_ws('|', '0', policy_id, src, dst, key)), policy_id, src, dst, key) <= 3")
def stratified_sample(spark, folder):
    """EVL-08, SRT-08: three edges of each policy by hash order; the sampling is the feature."""
    return V.stratified_sample(G.edges_of(table(spark, folder, "kg_edges")), "policy_id", ["policy_id", "src", "dst", "key"], 3)


@q("coref_score", f"WITH RECURSIVE {KG}, {REACH}, gold AS (SELECT DISTINCT policy_id AS app_id, src AS mention, dst AS antecedent FROM sub UNION SELECT policy_id, src, 'information' FROM sub) SELECT app_id, mention, CASE WHEN bool_and(r.src IS NOT NULL) THEN 'correct' WHEN bool_or(r.src IS NOT NULL) THEN 'partial' ELSE 'incorrect' END AS status FROM gold LEFT JOIN reach r ON r.policy_id = app_id AND r.src = mention AND r.dst = antecedent GROUP BY ALL")
def coref_score(spark, folder):
    """EVL-05, EVL-06, AGG-06."""
    s = subsum(edges(spark, folder))
    gold = s.select(F.col("policy_id").alias("app_id"), F.col("src").alias("mention"), F.col("dst").alias("antecedent")).unionByName(s.select(F.col("policy_id").alias("app_id"), F.col("src").alias("mention"), F.lit("information").alias("antecedent"))).distinct()
    return V.coref_scores(gold, G.closure(s).select(F.col("policy_id").alias("app_id"), F.col("src").alias("mention"), F.col("dst").alias("antecedent")))


@q("annotation_filter", "SELECT seg_uid, policy_id, text FROM segments WHERE text IS NOT NULL AND trim(text) NOT IN ('', 'x') AND len(tokens) > 2 ORDER BY policy_id, seg_uid")
def annotation_filter(spark, folder):
    """EVL-07, PRE-16, SNK-11."""
    return table(spark, folder, "segments").where("text is not null and trim(text) not in ('', 'x') and size(tokens) > 2").select("seg_uid", "policy_id", "text").orderBy("policy_id", "seg_uid")


@q("entity_merge_outer", """WITH b AS (SELECT lower(trim(name)) AS name, aliases, domains FROM entity_info UNION ALL SELECT lower(trim(name)), NULL, CASE WHEN homepage_url <> '' THEN [lower(homepage_url)] END FROM companies),
    x AS (SELECT name, list_sort(list_distinct(flatten(list(coalesce(aliases, []))))) AS aliases, list_sort(list_distinct(flatten(list(coalesce(domains, []))))) AS domains FROM b GROUP BY name) SELECT name, array_to_string(aliases, '|') AS aliases, array_to_string(domains, '|') AS domains FROM x""")
def entity_merge_outer(spark, folder):
    """PRE-01, PRE-06, PRE-09, AGG-11, SET-02."""
    a = table(spark, folder, "entity_info").select(F.lower(F.trim("name")).alias("name"), "aliases", "domains")
    b = table(spark, folder, "companies").select(F.lower(F.trim("name")).alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.when(F.col("homepage_url") != "", F.array(F.lower("homepage_url"))).alias("domains"))
    m = P.merge_entities(a, b, "name", ["aliases", "domains"])
    return m.select("name", F.array_join("aliases", "|").alias("aliases"), F.array_join("domains", "|").alias("domains"))


@q("category_union", "WITH c AS (SELECT lower(d) AS domain, unnest(categories) AS category FROM (SELECT unnest(domains) AS d, categories FROM entity_info)) SELECT domain, string_agg(DISTINCT category, '|' ORDER BY category) AS categories FROM c GROUP BY domain")
def category_union(spark, folder):
    """PRE-02, PRE-05: the categories of all owners of a domain."""
    c = table(spark, folder, "entity_info").select(F.explode("domains").alias("d"), "categories").select(F.lower("d").alias("domain"), F.explode("categories").alias("category"))
    return c.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set("category")), "|").alias("categories"))


@q("open_companies", "SELECT DISTINCT permalink, name, CASE WHEN regexp_matches(homepage_url, '^(?:[A-Za-z]+://)?[^/?#]+/?$') THEN lower(regexp_extract(homepage_url, '^(?:[A-Za-z]+://)?([^/?#]+)', 1)) END AS domain FROM companies WHERE lower(trim(coalesce(status, 'operating'))) <> 'closed'")
def open_companies(spark, folder):
    """PRE-03."""
    c = table(spark, folder, "companies").where("lower(trim(coalesce(status, 'operating'))) <> 'closed'")
    u = F.col("homepage_url")
    return c.select("permalink", "name", F.when(u.rlike("^(?:[A-Za-z]+://)?[^/?#]+/?$"), F.lower(F.regexp_extract(u, "^(?:[A-Za-z]+://)?([^/?#]+)", 1))).alias("domain")).distinct()


@q("acquisition_root", """WITH RECURSIVE l AS (SELECT left_id AS c, max(right_id) AS p FROM entity_pairs WHERE is_match AND right_id > left_id GROUP BY left_id), w AS (SELECT c, p, 1 AS n FROM l UNION ALL SELECT w.c, l.p, n + 1 FROM w JOIN l ON l.c = w.p WHERE n < 200) SELECT c AS left_id, arg_max(p, n) AS root FROM w GROUP BY c""")
def acquisition_root(spark, folder):
    """PRE-04: the last acquirer along a chain of takeovers."""
    l = table(spark, folder, "entity_pairs").where("is_match and right_id > left_id").groupBy("left_id").agg(F.max("right_id").alias("p"))
    return P.follow_to_root(l, "left_id", "p")


@q("unique_ngrams", r"""WITH w AS (SELECT entity_id, list_filter(regexp_split_to_array(lower(trim(name)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM entity_info WHERE name IS NOT NULL), i AS (SELECT entity_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), g AS (SELECT DISTINCT entity_id, array_to_string(w[i:i + k - 1], ' ') AS ngram FROM (SELECT *, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM i))
    SELECT ngram, min(entity_id) AS entity_id FROM g GROUP BY ngram HAVING min(entity_id) = max(entity_id)""")
def unique_ngrams(spark, folder):
    """PRE-07, PRE-08, NRM-04, AGG-09."""
    return P.unique_ngrams(table(spark, folder, "entity_info").where("name is not null"), "entity_id", "name")


@q("template_expand")
def template_expand(spark, folder):
    """PRE-10, UDX-06: templates of data types, made from the terms of the graphs; tested on fixed templates."""
    t = table(spark, folder, "kg_edges").where("target is not null").select(F.concat(F.lit("(your|the) "), F.trim("target"), F.lit(" (data|information)?")).alias("template")).distinct()
    return P.expand_templates(t, "template")


@q("label_vector", f"WITH {KG}, {KGE}, l AS (SELECT policy_id, list(DISTINCT label) AS ls FROM purp GROUP BY ALL) SELECT policy_id, array_to_string(list_transform(['advertising', 'analytics', 'legal', 'security', 'services'], lambda c: CASE WHEN list_contains(ls, c) THEN 1 ELSE 0 END), ',') AS bits FROM l")
def label_vector(spark, folder):
    """PRE-15."""
    f = G.clean_edges(table(spark, folder, "kg_edges")).select("policy_id", F.explode("purposes").alias("p")).groupBy("policy_id").agg(F.collect_set("p.label").alias("ls"))
    return f.select("policy_id", F.array_join(P.label_vector(F.col("ls"), ["advertising", "analytics", "legal", "security", "services"]).cast("array<string>"), ",").alias("bits"))


@q("zero_shot_threshold", "WITH s AS (SELECT left_id, list({'score': score, 'label': matched_on || '-' || pair_id}) AS s FROM entity_pairs WHERE score IS NOT NULL AND left_id IS NOT NULL GROUP BY left_id), o AS (SELECT left_id, list_sort(s, 'DESC') AS s FROM s) SELECT left_id, array_to_string(list_transform(CASE WHEN len(list_filter(s, lambda x: x.score > 0.95)) > 0 THEN list_filter(s, lambda x: x.score > 0.95) ELSE list_filter(s[1:1], lambda x: x.score > 0.6) END, lambda x: x.label), '|') AS labels FROM o")
def zero_shot_threshold(spark, folder):
    """NRM-08."""
    s = table(spark, folder, "entity_pairs").where("score is not null and left_id is not null").groupBy("left_id").agg(F.collect_list(F.struct("score", F.concat_ws("-", "matched_on", "pair_id").alias("label"))).alias("s"))
    return s.select("left_id", F.array_join(P.threshold_labels(F.col("s")), "|").alias("labels"))


@q("purpose_phrases", f"WITH {KG}, {KGE} SELECT DISTINCT phrase FROM purp")
def purpose_phrases(spark, folder):
    """PRE-19."""
    return G.clean_edges(table(spark, folder, "kg_edges")).select(F.explode("purposes").alias("p")).select(F.col("p.phrase").alias("phrase")).distinct()


@q("synthetic_sentences")
def synthetic_sentences(spark, folder):
    """PRE-11: filled templates with spans, the same for any partitioning, from all terms of the graphs."""
    e = table(spark, folder, "kg_edges")
    words = e.select(F.lit("DATA").alias("label"), F.lower(F.trim("target")).alias("word")).unionByName(e.select(F.lit("ACTOR").alias("label"), F.lower(F.trim("source")).alias("word"))).where("word <> ''")
    t = spark.createDataFrame([("%ACTOR% collects your %DATA%.",), ("We share %DATA% and %DATA% with %ACTOR%.",), ("Your %DATA% is never sold.",)], "template string")
    return P.fill_slots(t, words.select("label", "word"), 1000)


@q("training_corpus", "SELECT 'synthetic' AS source, 1000::BIGINT AS n UNION ALL SELECT 'rehearsal', count(*) FROM (SELECT DISTINCT text FROM segments WHERE segment_type = 'TEXT' AND text IS NOT NULL AND regexp_matches(trim(text), '[.!?]$')) UNION ALL SELECT 'noise', count(*) FROM (SELECT DISTINCT text FROM documents WHERE trim(text) <> '')")
def training_corpus(spark, folder):
    """PRE-13, PRE-20, PRE-21: sentences by source with their counts; rehearsal and noise are shuffled by a hash, each text once."""
    made = synthetic_sentences(spark, folder).select(F.lit("synthetic").alias("source"), "text", F.xxhash64("id").alias("order"))
    own = table(spark, folder, "segments").where("segment_type = 'TEXT' and text is not null").where(F.trim("text").rlike("[.!?]$")).select("text").distinct()
    noise = table(spark, folder, "documents").where("trim(text) <> ''").select("text").distinct()
    rest = [x.select(F.lit(k).alias("source"), "text", F.xxhash64("text").alias("order")) for k, x in (("rehearsal", own), ("noise", noise))]
    return made.unionByName(rest[0]).unionByName(rest[1]).groupBy("source").agg(F.count("*").alias("n"))

@q("actor_names", "WITH p AS (SELECT DISTINCT string_split(trim(lower(source)), ' ')[1] AS prefix FROM kg_edges WHERE trim(source) LIKE '% %'), c(cls) AS (VALUES ('provider'), ('partner'), ('network')) SELECT DISTINCT prefix || ' ' || cls AS name FROM p CROSS JOIN c UNION SELECT prefix || ' ' || cls || 's' FROM p CROSS JOIN c")
def actor_names(spark, folder):
    """PRE-14, JON-06, SET-02: the classes are a constant of three rows."""
    p = table(spark, folder, "kg_edges").select(F.split(F.trim(F.lower("source")), " ").alias("w")).where(F.size("w") > 1).select(F.col("w")[0].alias("prefix")).distinct()
    n = p.select(F.explode(F.transform(F.array(F.lit("provider"), F.lit("partner"), F.lit("network")), lambda c: F.concat("prefix", F.lit(" "), c))).alias("name"))
    return n.unionByName(n.select(F.concat("name", F.lit("s")).alias("name"))).distinct()


@q("rule_ner", r"SELECT DISTINCT lower(trim(source)) AS phrase, CASE WHEN regexp_matches(lower(source), '^\s*(we|us|i|you)\s*$') THEN 'ACTOR' WHEN regexp_matches(lower(source), '(partner|provider|vendor|processor|reseller|agency|authority|affiliate|network)s?\s*$') THEN 'ACTOR' WHEN regexp_matches(lower(source), '(data|information|address|number|identifier|history|log|profile|settings)\s*$') THEN 'DATA' ELSE 'NN' END AS label FROM kg_edges WHERE trim(source) <> ''")
def rule_ner(spark, folder):
    """PRE-12, TOK-03: the keyword cascade."""
    s = F.lower("source")
    label = F.when(s.rlike(r"^\s*(we|us|i|you)\s*$"), "ACTOR").when(s.rlike(r"(partner|provider|vendor|processor|reseller|agency|authority|affiliate|network)s?\s*$"), "ACTOR").when(s.rlike(r"(data|information|address|number|identifier|history|log|profile|settings)\s*$"), "DATA").otherwise("NN")
    return table(spark, folder, "kg_edges").where("trim(source) <> ''").select(F.lower(F.trim("source")).alias("phrase"), label.alias("label")).distinct()
