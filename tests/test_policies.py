"""Questions to policy graphs on a small table with loops, repeats, odd keys and several unspecific terms."""

import pytest

from clauseweave.operators import graph as G, kgraph as K, policies as P
from clauseweave.queries import CORE, analyses as N, graphs as Q
from oracle import same

KG = "policy_id string, source string, target string, key string, text array<string>, purposes map<string,array<string>>"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("graphs")
    e = [
        ("p", "We", "personal  information", "COLLECT", {"services": ["to serve"], "legal": []}), ("p", "we", "personal information", "collect ", {"analytics": ["to count", None]}), ("p", "third party", "usage data", "BE_SHARED", None),
        ("p", "third party", "partner", "SUBSUM", {}), ("p", "personal information", "email address", "SUBSUM", None), ("p", "email address", "home address", "SUBSUM", None), ("p", "home address", "email address", "SUBSUM", None),
        ("p", "usage data", "click", "SUBSUM", None), ("p", "partner", "click", "NOT_USE", {"security": ["to guard"]}), ("p", "click", "click", "SUBSUM", None), ("p", "odd", "even", "OTHER", None), ("p", None, "x", "COLLECT", None), ("p", "x", " ", "COLLECT", None),
        ("q", "billing details", "card number", "SUBSUM", None), ("q", "advertiser", "billing details", "NOT_COLLECT", None), ("q", "us", "card number", "STORE", {"advertising": ["to sell"]}), (None, "we", "lost data", "COLLECT", None),
        ("r", "a", "b", "SUBSUM", None), ("s", "broker", "red c", "USE", None), ("s", "red c", "blue d", "SUBSUM", None), ("s", "blue d", "red c", "SUBSUM", None),
    ]
    spark.createDataFrame([(p, s, t, k, ["said"], m) for p, s, t, k, m in e], KG).write.parquet(f"{at}/kg_edges.parquet")
    return str(at)


def test_every_unspecific_term_counts_for_every_data_type(spark, folder):
    name = "accept_unspecific"
    got = {tuple(r) for r in CORE.queries[name](spark, folder).select("policy_id", "src", "dst", "key").collect()}
    assert {("p", "we", x, "COLLECT") for x in ("email address", "home address", "usage data", "click", "odd", "even")} <= got and ("q", "advertiser", "card number", "NOT_COLLECT") in got
    same(CORE.queries[name], CORE.oracles[name], spark, folder)


# Each is answered in one pass over small policies, and by joins over large ones.
ONE_PASS = [
    "accept_unspecific", "summary_entity_matrix", "system_comparison", "validate_collection", "cannot_collect", "flow_consistency", "subsum_pairs", "consistency_rollup", "generic_term_sharing", "purposes_shortest", "who_collect",
]


@pytest.mark.parametrize("name", ONE_PASS)
def test_small_policies_write_no_closures(spark, folder, name, monkeypatch):
    """The closures of small policies don't go to disk; they were many times the edges' size."""

    def no_cut(df):
        raise AssertionError("a checkpoint")

    for m in (G, K, Q, N, P):
        if hasattr(m, "cut"):
            monkeypatch.setattr(m, "cut", no_cut)
    same(CORE.queries[name], CORE.oracles[name], spark, folder)


@pytest.mark.parametrize("name", ONE_PASS)
def test_large_policies_go_through_joins(spark, folder, name, monkeypatch):
    monkeypatch.setattr(P, "MOST", 2)
    same(CORE.queries[name], CORE.oracles[name], spark, folder)
