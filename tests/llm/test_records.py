import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseweave.llm import components as C, linkage as K, names as N
from clauseweave.llm.hosts import evidence_of, host_of
from clauseweave.llm.queries import LLM
from oracle import same


def test_p7_twin(spark, data):
    same(LLM.queries["p7_found"], LLM.oracles["p7_found"], spark, data)


def union_find(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_components(spark, shape):
    rng = random.Random(5)
    links = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "chain": [(i, i + 1) for i in range(200)], "star": [(0, i) for i in range(1, 300)]}[shape]
    df = spark.createDataFrame([*links, *links[:5], (None, 1), (2, None), (7, 7)], "a long, b long")
    assert {r.id: r.group_id for r in C.contract(df).collect()} == {k: v for k, v in union_find([(a, b) for a, b in links if a != b]).items()}


def test_components_edge_cases(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert C.contract(none).count() == 0
    ids = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "id long, a string")
    assert [tuple(r) for r in C.group_records(ids, none).collect()] == [(1, 1)]


def test_deletes_find_small_distances():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choices("abcdef", k=8))
        i = rng.randrange(7)
        b = rng.choice([a[:i] + a[i + 1 :], a[:i] + "x" + a[i:], a[:i] + "x" + a[i + 1 :], a[:i] + a[i + 1] + a[i] + a[i + 2 :]])
        assert N.distance(a, b, 2) <= 1 and N.deletes(a, 1) & N.deletes(b, 1)


@pytest.mark.parametrize("a,b", [("Wevnok Fasridtix Media LLC", "FASRIDTIX  WEVNOK MEDIA L.L.C."), ("WevnokFasridtix Media", "Wevnok & Fasridtx Media"), ("wevnokfasridtix", "Fasridtix Wevnok"), ("Bill Wevnok-Fasridtix", "Fasridtix Wevnok, William"), ("W. Fasridtix Media", "Fasridtix W. Media"), ("Wévnok Fasridtix", "Wevnok Fasridtix, Inc.")])
def test_variants(a, b):
    assert N.alike(N.form_of(N.parse(a)), N.form_of(N.parse(b)))


def test_keys_cover_alike_forms():
    rng = random.Random(3)
    forms = ["fasridtix wevnok", "kegfevguv kixmex", "desluxkinmex", "k kegfevguv"]
    for f in forms:
        for _ in range(200):
            i = rng.randrange(len(f))
            g = rng.choice([f[:i] + f[i + 1 :], f[:i] + "q" + f[i + 1 :]])
            if " " not in f or g.count(" ") == f.count(" ") and all(g.split()):
                h = " ".join(sorted(g.split()))
                assert not N.alike(f, h) or N.keys_of(f) & N.keys_of(h), (f, h)


RECORDS = [(1, "Wevnok Fasridtix Media LLC"), (2, "FASRIDTIX WEVNOK MEDIA"), (3, "Wevnok Fasridtix Games"), (4, "W. Fasridtix Games"), (5, "Wevnok Fasridtix"), (6, "Bill Haskon Gistelmar"), (7, "Gistelmar Haskon, William"), (8, "Susan Haskon Gistelmar"), (9, "Privacy Team"), (10, None), (11, "  "), (12, "Privacy Team")]


def test_resolution(spark):
    r = N.resolve_names(spark.createDataFrame(RECORDS, "entity_id long, name string"), spark.createDataFrame([(5, "m.example"), (1, "m.example")], "entity_id long, token string"))
    assert {tuple(x) for x in N.same_records(r).collect()} == {(1, 2), (3, 4), (1, 5), (2, 5), (6, 7)}
    none = spark.createDataFrame([], "entity_id long, name string")
    assert N.resolve_names(none, spark.createDataFrame([], "entity_id long, token string")).count() == 0


def test_hot_block_is_refined(spark):
    forms = [(f"fasridtix {a}{b}nok",) for a in "bdfgklmn" for b in ("ea", "io", "ou", "ei")] + [("fasridtix beanok",)]
    df = spark.createDataFrame(forms, "form string").distinct()
    pairs = lambda most: {tuple(r) for r in N.near_forms(df, most).collect()}
    assert pairs(2) == pairs(10_000) and pairs(2)


def test_hosts(spark):
    u = spark.createDataFrame([("HTTP://WWW.Acme.example/en/?x=1",), ("cdn.acme.example/",), ("",), (None,)], "u string")
    assert [r[0] for r in u.select(host_of(F.col("u"))).collect()] == ["acme.example", "acme.example", None, None]
    d = spark.createDataFrame([(i, [f"m{i}.cloud.example", "own.example" if i < 3 else f"o{i}.example"]) for i in range(60)] + [(99, None)], "entity_id long, domains array<string>")
    assert {(r.entity_id, r.token) for r in evidence_of(d).where("token = 'own.example'").collect()} == {(0, "own.example"), (1, "own.example"), (2, "own.example")} and evidence_of(d).where("token like '%cloud%'").count() == 0


def test_minhash_finds_like_names():
    hit = lambda a, b: bool(set(K.band_keys(a)) & set(K.band_keys(b)))
    assert hit("fasridtix wevnok", "fasridtx wevnok") and hit("fasridtix wevnok", "wevnok fasridtix") and not hit("fasridtix wevnok", "gistelmar haskon")


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))
    w = K.fit(x, (rng.random(4000) < p).astype(float))
    assert np.allclose(w, [2, -1, 0.5], atol=0.25)


def test_match_sources(spark):
    rng = random.Random(4)
    syl = ["wev", "fas", "kor", "lim", "tad", "nex", "gub", "pol"]
    word = lambda k: "".join(rng.choices(syl, k=k))
    firms = [(f"c{i}", f"{word(2)} {word(3)}", rng.choice(["media", "games", "labs"])) for i in range(80)]
    left = [(i, [f"{n} {t}".title(), n.upper()], None, t) for i, (_, n, t) in enumerate(firms)] + [(500, [], None, None)]
    right = [(c, f"{n.title()} {t.title()} Ltd", t) for c, n, t in firms] + [("x", None, None)]
    lh = [(i, f"h{i}.example") for i in range(80)]
    rh = [(c, f"h{i}.example") for i, (c, _, _) in enumerate(firms) if i % 4]
    m = K.match_sources(spark.createDataFrame(left, "lid long, names array<string>, third string, kind string"), spark.createDataFrame(right, "rid string, name string, kind string"), spark.createDataFrame(lh, "lid long, host string"), spark.createDataFrame(rh, "rid string, host string"))
    got = {(r.lid, r.rid) for r in m.where("confidence >= 0.5").collect()}
    want = {(i, c) for i, (c, _, _) in enumerate(firms)}
    assert len(got & want) >= 76 and len(got - want) <= 2


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(2)
    s = np.sort(rng.random(40))
    y = (rng.random(40) < s).astype(float)
    at, rate = K.isotonic(s, y)
    fitted = np.interp(s, at, rate)
    assert (np.diff(rate) > 0).all() and abs(fitted.mean() - y.mean()) < 0.05
    best = [max(min(y[i : j + 1].mean() for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert np.abs(np.unique(np.round(rate, 9)) - np.unique(np.round(best, 9))).max() < 1e-6


def test_few_labels_stay_near_the_prior():
    x = np.zeros((3, len(K.FEATURES)))
    m = K.Model(x, np.array([1.0, 0.0, -1.0]))
    assert np.abs(m.w - K.PRIOR).max() < 3 and 0 < m.u < m.m < 1
    none = K.Model(x, np.full(3, -1.0))
    assert np.allclose(none.w, K.PRIOR, atol=1e-3) and none.probability(x, np.array([1.0, 0.0, -1.0])).shape == (3,)


def test_reliability(spark):
    rng = random.Random(4)
    word = lambda k: "".join(rng.choices(["wev", "fas", "kor", "lim", "tad", "nex", "gub", "pol"], k=k))
    firms = [(i, f"{word(2)} {word(3)}") for i in range(60)]
    left = spark.createDataFrame([(i, [n], None, None) for i, n in firms], "lid long, names array<string>, third string, kind string")
    right = spark.createDataFrame([(i, n.title(), None) for i, n in firms], "rid long, name string, kind string")
    hosts = [(i, f"h{i}.example") for i in range(60)]
    args = (left, right, spark.createDataFrame(hosts, "lid long, host string"), spark.createDataFrame(hosts, "rid long, host string"))
    r = K.reliability(*K.score_pairs(*args)).toPandas()
    assert r.pairs.sum() >= 60 and r.predicted.between(0, 1).all()
    assert K.reliability(*K.score_pairs(left.limit(0), right, *args[2:])).count() == 0
