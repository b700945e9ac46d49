"""Blocks of names that many forms share."""

import random

import pytest

from clauseweave.llm import names as N

TWO_ERRORS = [("kaufmann wilhelmson", "laufmamn wilhelmson"), ("anderson johnsson", "anderssoon johnsson")]


@pytest.mark.parametrize("a,b", TWO_ERRORS)
def test_two_errors_survive_a_hot_key(spark, a, b):
    assert N.alike(a, b)
    df = spark.createDataFrame([(a,), (b,)], "form string")
    assert {tuple(r) for r in N.near_forms(df, 1).collect()} == {tuple(r) for r in N.near_forms(df, 64).collect()} == {tuple(sorted((a, b)))}


def test_refined_keys_lose_no_pair():
    rng = random.Random(11)
    words = ["kaufmann", "kauffman", "wilhelmson", "johnsson", "johnson", "anderson", "andersson", "mixkor", "makkor", "jonsons"]

    def damaged(w):
        i = rng.randrange(len(w) - 1)
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + "q" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])

    hits = 0
    for _ in range(3000):
        w = rng.sample(words, rng.choice([1, 2, 2, 2, 3]))
        v = list(w)
        for _ in range(rng.randrange(3)):
            j = rng.randrange(len(v))
            v[j] = damaged(v[j])
        if len(w) == 2 and rng.random() < 0.2:
            w[0] = w[0][0]
        if len(v) == 2 and rng.random() < 0.2:
            v = [v[0][0], v[1]] if rng.random() < 0.7 else [v[0] + v[1]]
        a, b = " ".join(sorted(w)), " ".join(sorted(v))
        shared = N.keys_of(a) & N.keys_of(b)
        if a != b and shared and N.alike(a, b):
            hits += 1
            assert all(N.refined(a, k) & N.refined(b, k) for k in shared), (a, b)
    assert hits > 1000


@pytest.mark.parametrize("a,b", [("Nokia GmbH", "NOKIA Corp."), ("IBM", "I.B.M. Inc."), ("SAP SE", "sap ag"), ("Apple Inc", "apple"), ("Intel Corporation", "INTEL corp"), ("Adobe Systems", "Adobe Sys"), ("Zoom Video", "ZOOM Video Inc")])
def test_short_names_have_forms(a, b):
    assert N.form_of(N.parse(a)) == N.form_of(N.parse(b)) is not None


def test_short_names_link_only_without_fuller_ones(spark):
    rows = [(1, "Nokia GmbH"), (2, "Nokia Corp."), (3, "Nokia"), (3, "Wevnok Fasridtix"), (4, "Wevnok Fasridtix Ltd"), (5, None)]
    _, fam = N.name_families(spark.createDataFrame(rows, "entity_id long, name string"))
    f = {r.entity_id: r.family for r in fam.collect()}
    assert f[1] == f[2] != f[3] == f[4] and 5 not in f
