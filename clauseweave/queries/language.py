"""Token tables, dependency patterns, annotators and practice statements.

The queries named parsed_... and phrase_stems run over what the rule provider makes of all segments. Those
of ``fixture`` compare the same operators with SQL on ten hand-annotated sentences and read no table.
"""

from pyspark.sql import functions as F

from clauseweave.operators import annotate as A, build as B, graph as G, normalize as N, provider as R, statements as S, tokens as T
from clauseweave.operators.segments import annotation_documents
from clauseweave.operators.sentences import annotate_documents, noun_phrase_rows, purpose_rows, stem_rows, subsumption_rows
from clauseweave.plans.registry import CORE
from clauseweave.plans.session import cut, ship, stash, table
from clauseweave.queries.fixture_tokens import rows, values
from clauseweave.queries.segments import seg

q = CORE.add
TOK = values()
BELOW = "dn AS (SELECT doc, sent, i, i AS j, 0 AS dist FROM tok UNION ALL SELECT d.doc, d.sent, d.i, t.i, dist + 1 FROM dn d JOIN tok t ON t.doc = d.doc AND t.sent = d.sent AND t.head = d.j AND t.i <> d.j)"
NOUN = "pos IN ('NOUN', 'PROPN', 'PRON')"
CHAIN = "cj AS (SELECT doc, sent, i, head FROM tok WHERE dep = 'conj'), link AS (SELECT doc, sent, i AS a, head AS b FROM cj UNION SELECT doc, sent, head, i FROM cj), rc AS (SELECT doc, sent, a AS i, a AS o FROM link UNION SELECT rc.doc, rc.sent, rc.i, link.b FROM rc JOIN link ON link.doc = rc.doc AND link.sent = rc.sent AND link.a = rc.o), con AS (SELECT doc, sent, i, min(o) AS first_i FROM rc GROUP BY ALL)"


def fixture(spark):
    ship(spark)
    return spark.createDataFrame(rows(), T.SCHEMA)


def parsed(spark, folder):
    """The token table of all English segments, parsed once for all that reads it."""
    return stash(R.parse(R.english(seg(spark, folder))))


@q("entity_spans_islands", f"WITH {TOK}, x AS (SELECT *, CASE WHEN ent_iob = 'B' OR lag(i) OVER w IS NULL OR lag(i) OVER w <> i - 1 OR lag(ent_type) OVER w <> ent_type THEN 1 ELSE 0 END AS new FROM tok WHERE ent_iob IN ('B', 'I') WINDOW w AS (PARTITION BY doc, sent ORDER BY i)), y AS (SELECT *, sum(new) OVER (PARTITION BY doc, sent ORDER BY i) AS s FROM x) SELECT doc, sent, min(ent_type) AS label, min(i) AS start_i, max(i) AS end_i, count(*) AS n FROM y GROUP BY doc, sent, s")
def entity_spans_islands(spark, folder):
    """TOK-03, TOK-04, D8."""
    return T.entity_spans(fixture(spark))


@q("head_subtree_bounds", f"WITH RECURSIVE {TOK}, {BELOW} SELECT doc, sent, i, min(j) AS left_i, max(j) AS right_i, count(*) AS n FROM dn GROUP BY ALL")
def head_subtree_bounds(spark, folder):
    """TOK-06."""
    return T.subtree_bounds(fixture(spark))


@q("conjunct_components", f"WITH RECURSIVE {TOK}, {CHAIN} SELECT doc, sent, i, first_i FROM con")
def conjunct_components(spark, folder):
    """TOK-07, GRA-09."""
    return T.conjuncts(fixture(spark))


@q("sentence_texts", f"WITH {TOK} SELECT doc, sent, string_agg(text, ' ' ORDER BY i) AS text FROM tok GROUP BY ALL")
def sentence_texts(spark, folder):
    """TOK-05, TOK-12."""
    return T.sentence_text(fixture(spark))


@q("dep_pattern_such_as", f"WITH {TOK} SELECT a.doc, a.sent, a.i AS a, s.i AS s, u.i AS u, l.i AS l FROM tok a JOIN tok s ON s.doc = a.doc AND s.sent = a.sent AND s.i = a.i - 1 AND s.lemma = 'such' JOIN tok u ON u.doc = a.doc AND u.sent = a.sent AND u.i = a.head AND u.{NOUN} JOIN tok l ON l.doc = a.doc AND l.sent = a.sent AND l.head = a.i AND l.dep = 'pobj' AND l.{NOUN} WHERE a.lemma = 'as' AND a.dep = 'prep'")
def dep_pattern_such_as(spark, folder):
    """TOK-10, ANN-02."""
    return T.match_pattern(fixture(spark), A.SUBSUM_PATTERNS["such_as"])


@q("dep_pattern_include", f"WITH {TOK} SELECT a.doc, a.sent, a.i AS a, u.i AS u, l.i AS l FROM tok a JOIN tok u ON u.doc = a.doc AND u.sent = a.sent AND u.head = a.i AND u.dep = 'nsubj' AND u.{NOUN} AND coalesce(u.ent_type, '') <> 'ACTOR' JOIN tok l ON l.doc = a.doc AND l.sent = a.sent AND l.head = a.i AND l.dep = 'dobj' AND l.{NOUN} WHERE a.lemma = 'include' AND a.pos = 'VERB'")
def dep_pattern_include(spark, folder):
    """TOK-10, ANN-04."""
    return T.match_pattern(fixture(spark), A.SUBSUM_PATTERNS["include"])


@q("subsumption_links", f"""WITH RECURSIVE {TOK}, {CHAIN}, f(doc, sent, src, dst, pattern) AS (VALUES ('a', 0, 3, 8, 'such_as'), ('b', 0, 1, 3, 'include'), ('c', 1, 6, 9, 'especially')), m AS (SELECT * FROM f UNION SELECT f.doc, f.sent, f.src, o.i, f.pattern FROM f JOIN con c ON c.doc = f.doc AND c.sent = f.sent AND c.i = f.dst AND c.first_i = f.dst JOIN con o ON o.doc = f.doc AND o.sent = f.sent AND o.first_i = f.dst) SELECT doc, sent, src, dst, pattern, 'SUBSUM' AS rel FROM m""")
def subsumption_links(spark, folder):
    """ANN-01..15, ANN-28, ANN-30: micro-goldens of the fixture."""
    return A.Subsumption().transform(fixture(spark))


@q("coref_lookback", "SELECT * FROM (VALUES ('a', 1, 3, 0, 3, 'COREF'), ('c', 2, 0, 1, 1, 'COREF')) t(doc, sent, src, dst_sent, dst, rel)")
def coref_lookback(spark, folder):
    """ANN-17..20, ANN-31, JON-12: micro-goldens of the fixture."""
    return A.Coreference().transform(fixture(spark))


@q("first_party", "SELECT * FROM (VALUES ('d', 0, 2, 0, 'SUBSUM')) t(doc, sent, src, dst, rel)")
def first_party(spark, folder):
    """ANN-16."""
    return A.FirstParty().transform(fixture(spark))


@q("purpose_links", "SELECT * FROM (VALUES ('b', 1, 0, 6, 'PURPOSE'), ('c', 2, 2, 6, 'PURPOSE')) t(doc, sent, src, dst, rel)")
def purpose_links(spark, folder):
    """ANN-24..26: micro-goldens of the fixture."""
    return A.Purposes().transform(fixture(spark))


@q("data_subject", "SELECT * FROM (VALUES ('c', 2, 2, 'children')) t(doc, sent, src, subject)")
def data_subject(spark, folder):
    """ANN-27."""
    return A.DataSubjects().transform(fixture(spark))


@q("negation_scope", "SELECT * FROM (VALUES ('a', 2, 3)) t(doc, sent, i)")
def negation_scope(spark, folder):
    """COL-02, COL-03, TOK-11."""
    return S.negated(fixture(spark))


@q("collect_share_rules", """SELECT * FROM (VALUES ('a', 0, 0, 3, 'COLLECT'), ('a', 1, 0, 3, 'COLLECT'), ('a', 1, 5, 3, 'BE_SHARED'), ('a', 2, 7, 5, 'NOT_BE_SOLD'), ('b', 1, 4, 0, 'USE'), ('c', 0, 0, 5, 'COLLECT'), ('c', 0, 2, 5, 'BE_SHARED'),
    ('c', 1, 1, 6, 'USE'), ('c', 1, 1, 9, 'USE'), ('c', 1, 1, 6, 'STORE'), ('c', 1, 1, 9, 'STORE'), ('c', 2, 0, 2, 'COLLECT'), ('d', 0, 5, 8, 'COLLECT'), ('d', 0, 10, 8, 'BE_SHARED')) t(doc, sent, src, dst, key)""")
def collect_share_rules(spark, folder):
    """COL-01..17: micro-goldens of the fixture."""
    return S.statements(fixture(spark))


@q("phrase_stems")
def phrase_stems(spark, folder):
    """TOK-08, TOK-09."""
    return stem_rows(R.english(seg(spark, folder)))


@q("parsed_entity_spans")
def parsed_entity_spans(spark, folder):
    """TOK-03, TOK-04, D8."""
    return T.entity_spans(parsed(spark, folder))


@q("parsed_subtree_bounds")
def parsed_subtree_bounds(spark, folder):
    """TOK-06."""
    return T.subtree_bounds(parsed(spark, folder))


@q("parsed_conjuncts")
def parsed_conjuncts(spark, folder):
    """TOK-07, GRA-09."""
    return T.conjuncts(parsed(spark, folder))


@q("parsed_sentence_texts")
def parsed_sentence_texts(spark, folder):
    """TOK-05, TOK-12."""
    return T.sentence_text(parsed(spark, folder))


@q("parsed_such_as")
def parsed_such_as(spark, folder):
    """TOK-10, ANN-02."""
    return T.match_pattern(parsed(spark, folder), A.SUBSUM_PATTERNS["such_as"])


@q("parsed_include")
def parsed_include(spark, folder):
    """TOK-10, ANN-04."""
    return T.match_pattern(parsed(spark, folder), A.SUBSUM_PATTERNS["include"])


@q("parsed_subsumption")
def parsed_subsumption(spark, folder):
    """ANN-01..15, ANN-28, ANN-30."""
    return subsumption_rows(R.english(seg(spark, folder)))


@q("parsed_coreference")
def parsed_coreference(spark, folder):
    """ANN-17..20, ANN-31, JON-12."""
    return A.Coreference().transform(parsed(spark, folder))


@q("parsed_first_party")
def parsed_first_party(spark, folder):
    """ANN-16."""
    return A.FirstParty().transform(parsed(spark, folder))


@q("parsed_purposes")
def parsed_purposes(spark, folder):
    """ANN-24..26."""
    return purpose_rows(R.english(seg(spark, folder)))


@q("parsed_data_subjects")
def parsed_data_subjects(spark, folder):
    """ANN-27."""
    return A.DataSubjects().transform(parsed(spark, folder))


@q("parsed_negations")
def parsed_negations(spark, folder):
    """COL-02, COL-03, TOK-11."""
    return S.negated(parsed(spark, folder))


@q("parsed_statements")
def parsed_statements(spark, folder):
    """COL-01..17."""
    return S.statements(parsed(spark, folder))


@q("list_propagation", "WITH items AS (SELECT DISTINCT policy_id AS doc, parent_id AS list_id, segment_id AS node FROM segments WHERE parent_id IS NOT NULL), l AS (SELECT doc, min(node) AS src, max(list_id) AS dst FROM items GROUP BY doc), a AS (SELECT l.doc, b.node AS src, l.dst FROM l JOIN items a ON a.doc = l.doc AND a.node = l.src JOIN items b ON b.doc = a.doc AND b.list_id = a.list_id), b AS (SELECT l.doc, l.src, y.node AS dst FROM l JOIN items x ON x.doc = l.doc AND x.node = l.dst JOIN items y ON y.doc = x.doc AND y.list_id = x.list_id) SELECT DISTINCT * FROM (SELECT * FROM l UNION ALL SELECT * FROM a UNION ALL SELECT * FROM b) WHERE src <> dst")
def list_propagation(spark, folder):
    """ANN-21..23."""
    items = table(spark, folder, "segments").where("parent_id is not null").select(F.col("policy_id").alias("doc"), F.col("parent_id").alias("list_id"), F.col("segment_id").alias("node")).distinct()
    links = items.groupBy("doc").agg(F.min("node").alias("src"), F.max("list_id").alias("dst")).withColumn("rel", F.lit("LINK"))
    return A.spread_over_items(links, items).select("doc", "src", "dst")


@q("phrase_normalize", "WITH p AS (SELECT DISTINCT lower(trim(regexp_replace(target, '\\s+', ' ', 'g'))) AS phrase FROM kg_edges WHERE trim(coalesce(target, '')) <> ''), r(term, yes, no) AS (VALUES " + ", ".join(f"('{t}', '{y}', '{n}')" for t, y, n in N.sql_rules("DATA")) + ") SELECT phrase, term FROM p JOIN r ON regexp_matches(phrase, yes) AND (no = '' OR NOT regexp_matches(phrase, no))")
def phrase_normalize(spark, folder):
    """NRM-01..03, BLD-10, OPT-09, JON-10: every normal form that a phrase matches."""
    p = table(spark, folder, "kg_edges").select(F.lower(F.trim(F.regexp_replace("target", r"\s+", " "))).alias("phrase")).where("phrase <> ''").distinct()
    return N.normalize(p, "phrase", "DATA")


@q("entity_ngram_match", r"""WITH u AS (SELECT permalink, lower(trim(name)) AS name FROM (SELECT DISTINCT permalink, name FROM companies)), e AS (SELECT DISTINCT entity_id, lower(trim(a)) AS alias FROM (SELECT entity_id, unnest(aliases) AS a FROM entity_info) WHERE trim(a) <> '') SELECT DISTINCT u.permalink, e.entity_id FROM u JOIN e ON e.alias = u.name""")
def entity_ngram_match(spark, folder):
    """NRM-04..06: names that are an alias as a whole; partial ones by unique n-grams are in unique_ngrams."""
    u = table(spark, folder, "companies").select("permalink", F.lower(F.trim("name")).alias("name")).distinct()
    e = table(spark, folder, "entity_info").select("entity_id", F.explode("aliases").alias("a")).select("entity_id", F.lower(F.trim("a")).alias("name")).where("name <> ''").distinct()
    return u.join(e, "name").select("permalink", "entity_id").distinct()


@q("purpose_classes")
def purpose_classes(spark, folder):
    """NRM-07, UDX-07, OPT-08: distinct purposes through the pluggable model, then joined back."""
    from clauseweave.operators.graph import clean_edges

    p = clean_edges(table(spark, folder, "kg_edges")).select(F.explode("purposes").alias("p")).select(F.col("p.phrase").alias("phrase")).distinct()
    return p.withColumn("labels", F.array_join(N.classify_purpose(F.col("phrase")), "|"))


@q("parsed_tokens")
def parsed_tokens(spark, folder):
    """TOK-01, UDX-02, UDX-03: the rule provider over all English segments."""
    return R.parse(R.english(seg(spark, folder)))


def english_segments(spark, folder):
    """The latest segments that state English or nothing."""
    return seg(spark, folder).where("lang is null or lower(trim(lang)) like 'en%' or lower(trim(lang)) in ('', 'und', 'unknown')")


@q("policy_graph")
def policy_graph(spark, folder):
    """BLD-01..19, NRM-06 end to end: contextual documents of all segments, one annotation pass, one graph per policy."""
    e = table(spark, folder, "entity_info").where("entity is not null").select("entity", "aliases", "domains", "ngrams")
    return B.build_from_segments(english_segments(spark, folder), entities=e)


@q("policy_graph_trimmed")
def policy_graph_trimmed(spark, folder):
    """BLD-18: what the statements of the graphs need."""
    return G.trim_graph(B.build_from_segments(english_segments(spark, folder)))


@q("policy_graph_extended")
def policy_graph_extended(spark, folder):
    """BLD-13: all kinds of statements, data of children apart."""
    return B.build_from_segments(english_segments(spark, folder), "extended")


@q("noun_phrases")
def noun_phrases(spark, folder):
    """TOK-02: the noun phrases that part each sentence of all segments."""
    return noun_phrase_rows(R.english(seg(spark, folder)))


@q("annotated_links")
def annotated_links(spark, folder):
    """ANN-01..31, COL-01..17: the links between phrases of all contextual documents, once each."""
    r = annotate_documents(annotation_documents(english_segments(spark, folder)))
    return r.where("kind = 'link'").select("policy_id", F.col("a").alias("src"), F.col("b").alias("dst"), "rel").distinct()


@q("annotated_without_purposes")
def annotated_without_purposes(spark, folder):
    """ANN-29, UDX-01: the same pass with annotators left out."""
    r = annotate_documents(annotation_documents(english_segments(spark, folder)), ("purpose", "subject", "coreference"))
    return r.groupBy("kind", "rel").agg(F.count("*").alias("n"))


@q("coref_pointer_jump", "WITH RECURSIVE e AS (SELECT left_id AS src, min(right_id) AS dst FROM entity_pairs WHERE is_match AND right_id < left_id GROUP BY left_id), w AS (SELECT src, dst, 1 AS n FROM e UNION ALL SELECT w.src, e.dst, n + 1 FROM w JOIN e ON e.src = w.dst WHERE n < 200) SELECT src, arg_max(dst, n) AS main FROM w GROUP BY src")
def coref_pointer_jump(spark, folder):
    """BLD-06, OPT-04: mentions with one antecedent follow it to the main mention."""
    e = table(spark, folder, "entity_pairs").where("is_match and right_id < left_id").groupBy(F.col("left_id").alias("src")).agg(F.min("right_id").alias("dst"))
    return B.main_mentions(cut(e))
