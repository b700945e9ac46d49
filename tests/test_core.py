import random

import pytest
from pyspark.sql import functions as F

from clauseweave.operators import annotate, build, evals, graph, ontology, prep, segments, statements, tokens
from clauseweave.operators.fuzzy import partial_ratio
from clauseweave.operators.hierarchy import descendants, resolve_hierarchy, subsumption_edges
from clauseweave.queries import CORE
from clauseweave.queries.fixture_tokens import rows as token_rows
from oracle import same

TWINS = [
    "p5_found", "p5_descendants", "reach_policy", "node_types", "transitive_reduction", "redundant_collect_prune", "trim_graph", "topo_depth", "who_collect", "purposes_shortest", "evidence_text",
    "contradictions", "flow_consistency", "summary_entity_matrix", "self_defined_terms", "precision_recall_groups", "multilabel_metrics", "stratified_sample", "unique_ngrams", "tree_flatten", "heading_parent",
    "context_docs", "content_dedup", "nearest_snapshot", "strip_boilerplate", "entity_spans_islands", "subsumption_links", "collect_share_rules", "coref_lookback", "phrase_normalize", "events_session_window", "yaml_links",
]


@pytest.mark.parametrize("name", TWINS)
def test_twin(name, spark, data):
    same(CORE.queries[name], CORE.oracles[name], spark, data)


def resolved(spark, edges):
    df = spark.createDataFrame(edges, "g string, parent string, child string, node string")
    return {(r.g, r.node): (r.root, r.depth, list(r.path_nodes)) for r in resolve_hierarchy(df, ["g"]).collect()}


def test_hierarchy_cases(spark):
    r = resolved(spark, [("a", "x", "y", "clash"), ("a", "x", "y", "clash"), ("a", "y", "z", None), ("a", "l", "m", None), ("a", "m", "l", None), ("a", "m", "below", None), ("a", "s", "s", None), ("b", "x", "z", None), ("a", None, "q", None), (None, "x", "y", None)])
    assert r["a", "z"] == ("x", 2, ["x", "y", "z"]) and r["a", "x"] == ("x", 0, ["x"]) and r["b", "z"] == ("x", 1, ["x", "z"])
    assert all(r["a", n] == ("", -1, []) for n in ("l", "m", "below", "s")) and ("a", "q") not in r


def test_hierarchy_against_walk(spark):
    rng = random.Random(3)
    parent = {f"n{i}": f"n{rng.randrange(i)}" for i in range(1, 200)} | {f"c{i}": f"c{i + 1}" for i in range(130)}
    r = resolved(spark, [("g", p, c, None) for c, p in parent.items()])
    for n, (root, depth, path) in ((k[1], v) for k, v in r.items()):
        walk = [n]
        while walk[0] in parent:
            walk.insert(0, parent[walk[0]])
        assert (root, depth, path) == (walk[0], len(walk) - 1, walk)


def test_hierarchy_empty(spark):
    df = resolve_hierarchy(spark.createDataFrame([], "g string, parent string, child string"), ["g"])
    assert df.count() == 0 and descendants(df, ["g"]).count() == 0


def test_subsumption_terms(spark):
    kg = spark.createDataFrame([("p", " A  b", "c d ", " subsum ", 1), ("p", "", "x", "SUBSUM", 1), ("p", "a", None, "SUBSUM", 1), ("p", "a", "b", None, 1), ("p", "a", "b", "USE", 1)], "policy_id string, source string, target string, key string, extra int")
    assert [tuple(r) for r in subsumption_edges(kg).collect()] == [("p", "a b", "c d")]


def edges(spark, rows_):
    return spark.createDataFrame(rows_, "policy_id string, src string, dst string, key string")


def test_reduction_keeps_closure(spark):
    rng = random.Random(1)
    e = edges(spark, [("p", f"n{a}", f"n{b}", "SUBSUM") for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.4])
    pairs = lambda x: {tuple(r) for r in graph.closure(x).select("src", "dst").collect()}
    r = graph.transitive_reduction(e)
    assert pairs(r) == pairs(e) and r.count() < e.count()


def test_closure_with_loop(spark):
    e = edges(spark, [("p", "a", "b", "SUBSUM"), ("p", "b", "a", "SUBSUM"), ("p", "b", "c", "SUBSUM")])
    assert {tuple(r) for r in graph.closure(e).select("src", "dst", "dist").collect()} == {("a", "b", 1), ("b", "a", 1), ("a", "a", 2), ("b", "b", 2), ("b", "c", 1), ("a", "c", 2)}
    assert graph.closure(e.limit(0)).count() == 0


def test_trim_is_idempotent(spark):
    e = edges(spark, [("p", "we", "a", "COLLECT"), ("p", "a", "b", "SUBSUM"), ("p", "c", "d", "SUBSUM")])
    once = graph.trim_graph(e)
    assert {r.src for r in once.collect()} == {"we", "a"} and graph.trim_graph(once).count() == once.count()


def test_ontology_extension(spark):
    o, n = ontology.data_ontology(spark)
    x = ontology.extend_graph(edges(spark, [("p", "we", "email address", "COLLECT")]), o, n, spark.createDataFrame([("p", "imei")], "policy_id string, node string"))
    got = {(r.src, r.dst) for r in x.where("key = 'SUBSUM'").collect()}
    assert ("contact information", "email address") in got and ("hardware identifier", "imei") in got and ("contact information", "phone number") not in got
    assert o.count() == 44 and n.count() == 45 + 0 or n.count() > 40


TREE = [("document", None, None, -1), ("heading", "Data", 1, 0), ("text", "We collect:", None, 0), ("list", None, None, 0), ("listitem", None, None, 3), ("text", "names", None, 4), ("link", "stray", None, 3), ("button", "OK", None, 0), ("heading", "More", 2, 0), ("paragraph", None, None, 0), ("text", "one", None, 9), ("link", "two", None, 9)]


def test_segment_walk():
    found = segments.segments_of(*[list(x) for x in zip(*TREE)])
    assert found == [["HEADING", None, "Data"], ["TEXT", 0, "We collect:"], ["LISTITEM", 1, ""], ["TEXT", 2, "names"], ["LISTITEM", 1, ""], ["TEXT", 4, "stray"], ["HEADING", 0, "More"], ["TEXT", 6, "one two"]]


def test_typed_lists():
    f = [["HEADING", None, "We use:"], ["TEXT", 0, "1. names"], ["TEXT", 0, "2. mails"], ["TEXT", 0, "4. other"]]
    assert segments.typed_lists(f) == [["HEADING", None, "We use:"], ["LISTITEM", 0, ""], ["TEXT", 1, "names"], ["LISTITEM", 0, ""], ["TEXT", 3, "mails"], ["TEXT", 0, "4. other"]]
    with pytest.raises(ValueError):
        segments.segments_of(["document", "mystery"], [None, "x"], [None, None], [-1, 0])


def test_broken_trees():
    assert segments.flatten_tree(None) == [] and segments.flatten_tree("{") == [] and segments.flatten_tree("[]") == []


def test_patterns_and_rules(spark):
    t = spark.createDataFrame(token_rows(), tokens.SCHEMA)
    with pytest.raises(ValueError):
        tokens.parse_pattern("a[x=y], b > c[noun]")
    with pytest.raises(ValueError):
        statements.parse_rule("nonsense")
    with pytest.raises(ValueError):
        annotate.annotate(t, disable=("nothing",))
    assert len([statements.parse_rule(x) for x in statements.RULES.strip().splitlines()]) == 23
    assert set(annotate.annotate(t, disable=("purpose", "subject", "subsumption"))) == {"coreference", "first_party"}
    assert tokens.match_pattern(t.limit(0), "a[noun]").count() == 0
    with pytest.raises(ValueError):
        build.build_graph(t, "other")


def test_build_on_fixture(spark):
    t = spark.createDataFrame(token_rows(), tokens.SCHEMA).withColumn("doc", F.concat("doc", F.lit("#000001")))
    g = {(r.policy_id, r.src, r.dst, r.key) for r in build.build_graph(t, "extended").collect()}
    assert ("a", "we", "personal information", "COLLECT") in g and ("a", "personal information", "email address", "SUBSUM") in g and ("a", "advertiser", "device identifier", "NOT_BE_SOLD") in g


def test_templates_and_vectors(spark):
    assert prep.expand_template("(your|the) e-?mail (address)?") == ["your e-mail address", "your e-mail", "your email address", "your email", "the e-mail address", "the e-mail", "the email address", "the email"]
    a = prep.fill_slots(spark.createDataFrame([("Send %A%.",)], "template string"), spark.createDataFrame([("A", "x"), ("A", "y")], "label string, word string"), 20)
    assert a.count() == 20 and all(r.text[s.start : s.end] in ("x", "y") for r in a.collect() for s in r.spans)


def test_metrics(spark):
    t = spark.createDataFrame([("a", 1, "g"), ("b", 1, "g"), ("c", 0, "h")], "k string, y int, grp0 string")
    f = spark.createDataFrame([("a",), ("c",), ("d",)], "k string")
    r = {x.grp: (x.tp, x.fp, x.fn) for x in evals.precision_recall(t, f, ["k"], "y", "grp0").collect()}
    assert r["g"] == (1, 0, 1) and r["h"] == (0, 1, 0) and r["none"] == (0, 1, 0) and r["all"] == (1, 2, 1)


def test_partial_ratio():
    assert partial_ratio("we sell data", "Indeed we sell data here") == 100 and partial_ratio("", "x") == 0 and partial_ratio("we sell dat4", "indeed we sell data here") > 85


def test_chase_and_root(spark):
    l = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5)], "a long, b long")
    assert {(r.a, r.root) for r in prep.follow_to_root(l, "a", "b").collect()} == {(1, 3), (2, 3), (5, 5), (6, 5)}
