"""The one-pass annotators against the same steps as joins, and against what each pattern and rule is for."""

import random

import pytest
from pyspark.sql import functions as F

from clauseweave.operators import annotate as A, build as B, graph as G, normalize as N, provider as R, segments as SG, sentences as Z, statements as S, tokens as T
from clauseweave.queries.fixture_tokens import rows as fixture_rows
from clauseweave.queries.pattern_tokens import PATTERN_SENTENCES, RULE_SENTENCES, rows


def sentences_of(table):
    by = {}
    for r in table:
        by.setdefault((r[0], r[1]), []).append((r[2], *r[3:7], r[7], *r[8:]))
    return {k: Z.Sentence(v) for k, v in by.items()}


@pytest.mark.parametrize("name", list(PATTERN_SENTENCES))
def test_each_pattern_fires(name):
    s = sentences_of(rows({name: PATTERN_SENTENCES[name]}))[name, 0]
    hits = Z.find(s, A.SUBSUM_PATTERNS[name])
    assert hits and all(s.lemma[m["u"]] == "data" and s.lemma[m["l"]] in ("name", "some") for m in hits)


@pytest.mark.parametrize("name", list(RULE_SENTENCES))
def test_each_rule_fires(name):
    s = sentences_of(rows({name: RULE_SENTENCES[name]}))[name, 0]
    hits = {(s.lemma[a], s.lemma[d], key) for a, d, key, rule in Z.statements(s) if rule == name}
    what = "data" if name.startswith("data") else "name"
    assert hits and all(d == what for _, d, _ in hits)
    want = {"share with": {("we", what, "COLLECT"), ("partner", what, "BE_SHARED")}, "sell to": {("we", what, "COLLECT"), ("partner", what, "BE_SOLD")}, "require to provide to": {("user", what, "COLLECT"), ("we", what, "BE_SHARED")}, "allow to use": {("partner", what, "USE")}, "have to store": {("we", what, "STORE")}, "data used include": {("we", what, "USE")}}.get(name)
    assert want is None or hits == want


@pytest.fixture(scope="module")
def table(spark, data):
    from clauseweave.queries.segments import seg

    parsed = [tuple(r) for r in R.parse(R.english(seg(spark, data))).collect()]
    return fixture_rows() + rows(PATTERN_SENTENCES) + rows(RULE_SENTENCES) + parsed


def test_same_as_joins(spark, table):
    t = spark.createDataFrame(table, T.SCHEMA).cache()
    sents = sentences_of(table)
    got = lambda df, *c: {tuple(r) for r in df.select(*c).collect()}
    assert got(A.Subsumption().transform(t), "doc", "sent", "src", "dst", "pattern") == {(*k, u, x, n) for k, s in sents.items() for u, x, n in Z.subsumption(s)}
    assert got(A.Purposes().transform(t), "doc", "sent", "src", "dst") == {(*k, d, v) for k, s in sents.items() for d, v in Z.purposes(s)}
    assert got(A.DataSubjects().transform(t), "doc", "sent", "src") == {(*k, d) for k, s in sents.items() for d in Z.of_children(s)}
    assert got(A.FirstParty().transform(t), "doc", "sent", "src", "dst") == {(*k, a, b) for k, s in sents.items() for a, b in Z.first_party(s)}
    assert got(S.negated(t), "doc", "sent", "i") == {(*k, i) for k, s in sents.items() for i in Z.negated(s)}
    assert got(S.relations(t), "doc", "sent", "parent", "rel", "child") == {(*k, *r) for k, s in sents.items() for r in Z.relations(s)}
    assert got(S.statements(t), "doc", "sent", "src", "dst", "key") == {(*k, a, d, key) for k, s in sents.items() for a, d, key, _ in Z.statements(s)}
    assert got(T.conjuncts(t), "doc", "sent", "i", "first_i") == {(*k, i, f) for k, s in sents.items() for i, f in s.chains.items()}
    assert got(T.below(t), "doc", "sent", "i", "j", "dist") == {(*k, i, j, d) for k, s in sents.items() for i in range(s.n) for j, d in s.below(i).items()}
    docs = {}
    for (doc, sent), s in sorted(sents.items()):
        docs.setdefault(doc, []).append((sent, s))
    assert got(A.Coreference().transform(t), "doc", "sent", "src", "dst_sent", "dst") == {(doc, ss[k][0], i, ss[m][0], j) for doc, ss in docs.items() for k, i, m, j in Z.coreference([s for _, s in ss])}


def test_noun_phrases():
    s = Z.Sentence(R.parse_sentence("We share your email address with partners .".split()))
    assert [(s.text[h], a, b) for h, a, b in Z.noun_phrases(s)] == [("We", 0, 0), ("address", 2, 4), ("partners", 6, 6)]


def kept_one_by_one(edges):
    out, below = [], {}

    def reaches(a, b, seen=()):
        return a == b or any(reaches(x, b, (*seen, a)) for x in below.get(a, ()) if x not in seen)

    for u, v in edges:
        if u != v and not reaches(v, u):
            below.setdefault(u, set()).add(v)
            out.append((u, v))
    return set(out)


def test_without_closing_edges(spark):
    rng = random.Random(3)
    graphs = {f"p{k}": sorted({(rng.randrange(6), rng.randrange(6)) for _ in range(rng.choice([3, 8, 14, 20]))}) for k in range(12)}
    df = spark.createDataFrame([(p, u, v, "x") for p, es in graphs.items() for u, v in es] + [(None, 1, 2, "x"), ("p0", None, 1, "x")], "policy_id string, src int, dst int, rank string")
    got = {}
    for r in G.without_closing_edges(df).collect():
        got.setdefault(r.policy_id, set()).add((r.src, r.dst))
    assert got == {p: w for p, es in graphs.items() if (w := kept_one_by_one(es))}
    assert G.without_closing_edges(df.limit(0)).count() == 0


@pytest.mark.parametrize("phrase,lemma,stem,kind,falls,want", [("your precise location", "your precise location", "precise location", "DATA", True, ["precise geolocation"]), ("SSN", "ssn", "ssn", "DATA", True, ["ssn"]), ("information that cannot identify you", "information that cannot identify you", "information", "DATA", False, ["non-personal information"]), ("shoe sizes", "shoe size", "shoe size", "DATA", True, ["shoe size"]), ("shoe sizes", "shoe size", "shoe size", "DATA", False, []), ("\0", "it", "it", "DATA", True, ["UNSPECIFIED"]), ("our affiliated companies", "our affiliate company", "affiliate company", "ACTOR", True, ["we"]), ("advertising networks", "advertising network", "advertising network", "ACTOR", True, ["advertiser"]), ("third-party vendors", "third - party vendor", "vendor", "ACTOR", True, ["UNSPECIFIED"])])
def test_phrase_terms(spark, phrase, lemma, stem, kind, falls, want):
    df = spark.createDataFrame([(phrase, lemma, stem)], "p string, l string, s string")
    assert df.select(N.phrase_terms(F.col("p"), F.col("l"), F.col("s"), kind, F.lit(falls)).alias("t")).first().t == want


SEG = "policy_id string, segment_id int, segment_type string, parent_id int, tokens array<string>"


def test_graph_over_a_list(spark):
    """Items under an introduction, a head over them, an anaphor, a purpose and a child's data make one graph."""
    w = lambda s: s.split()
    segs = [
        ("p", 0, "HEADING", None, w("What we collect")), ("p", 1, "TEXT", 0, w("We collect the following data :")), ("p", 2, "LISTITEM", 1, w("email address")), ("p", 3, "LISTITEM", 1, w("phone number")),
        ("p", 4, "TEXT", 0, w("We share cookies with advertisers to show ads .")), ("q", 0, "TEXT", None, w("We collect personal information such as email address . We share this information with partners .")), ("q", 1, "TEXT", None, []), (None, 2, "TEXT", None, w("lost")),
    ]
    df = spark.createDataFrame(segs, SEG)
    docs = {(r.policy_id, r.segment_id): r for r in SG.annotation_documents(df).collect()}
    assert docs["p", 2].words[:3] == w("What we collect") and docs["p", 2].words[-2:] == w("email address") and docs["p", 2].item == 2 and ("q", 1) not in docs and ("p", 0) not in docs
    g = {(r.policy_id, r.src, r.dst, r.key): r for r in B.build_from_segments(df).collect()}
    assert ("p", "we", "cookie / pixel tag", "COLLECT") in g and g["p", "we", "cookie / pixel tag", "COLLECT"].purposes.startswith("advertising=")
    assert ("q", "we", "personal information", "COLLECT") in g and ("q", "personal information", "email address", "SUBSUM") in g
    collected = {d for p, s, d, k in g if p == "p" and k == "COLLECT"}
    assert {"email address", "phone number"} <= collected | {d for p, s, d, k in g if k == "SUBSUM"}
    per = B.build_from_segments(df, "per_sentence")
    assert per.where("src like 'we (%'").count() > 0
    assert B.build_from_segments(df.limit(0)).count() == 0


def test_match_entities(spark):
    e = spark.createDataFrame([("acme", ["Acme Corp", "Acme Media"], ["acme.example"], {"acme": True}), ("apple", ["Apple Inc"], None, {"apple": False, "apple maps": True}), ("none", None, [], None)], "entity string, aliases array<string>, domains array<string>, ngrams map<string,boolean>")
    n = spark.createDataFrame([("ACME and friends",), ("acme.example",), ("an apple a day",), ("Apple",), ("Apple Maps",), (None,), ("",), ("Apple",)], "name string")
    assert {tuple(r) for r in N.match_entities(n, e).collect()} == {("ACME and friends", "acme"), ("acme.example", "acme"), ("Apple", "apple"), ("Apple Maps", "apple")}


def test_deep_trees():
    n = 20_000
    found = SG.segments_of(["document"] + ["section"] * n + ["text"], [None] * (n + 1) + ["end"], [None] * (n + 2), [-1, *range(n + 1)])
    assert found == [["TEXT", None, "end"]]
    assert SG.segments_of(["document", "mystery"], [None, "x"], [None, None], [-1, 0], strict=False) == [["TEXT", None, "x"]]


def test_shortest_paths(spark):
    e = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "a", "d"), ("p", "d", "c"), ("p", "c", "a"), ("p", "a", "a"), (None, "a", "b")], "policy_id string, src string, dst string")
    got = {(r.node, r.top): (r.dist, r.path) for r in G.shortest_paths(e).collect()}
    assert got["c", "a"] == (2, "c < b < a") and got["a", "c"] == (1, "a < c") and got["b", "d"] == (3, "b < a < c < d")


def test_noun_phrases_part_the_sentences(spark, data):
    """Phrases of a sentence don't overlap, hold their head, and no noun outside a compound is left out."""
    from clauseweave.queries import CORE

    p = CORE.queries["noun_phrases"](spark, data).toPandas()
    t = CORE.queries["parsed_tokens"](spark, data).toPandas()
    assert ((p["first"] <= p["head"]) & (p["head"] <= p["last"])).all()
    q = p.sort_values(["doc", "sent", "first"])
    again = (q["doc"] == q["doc"].shift()) & (q["sent"] == q["sent"].shift())
    assert (q["first"] > q["last"].shift())[again].all()
    covered = {(d, s, i) for d, s, a, b in zip(p["doc"], p["sent"], p["first"], p["last"]) for i in range(a, b + 1)}
    nouns = t[t.pos.isin(["NOUN", "PROPN"]) & ~t.dep.isin(["compound", "poss"])]
    assert {(r.doc, r.sent, r.i) for r in nouns.itertuples()} <= covered
