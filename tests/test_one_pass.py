"""Queries over sentences that never leave their row: same rows as the joins, without their plans, which filled the driver's memory."""

import pytest

from clauseweave.operators import annotate as A, tokens as T
from clauseweave.queries import CORE
from clauseweave.queries.language import parsed
from oracle import same

JOINS = {"parsed_purposes": lambda t: A.Purposes().transform(t), "parsed_subsumption": lambda t: A.Subsumption().transform(t), "phrase_stems": T.phrase_stems}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOINS)
def test_parsed_without_joins(spark, data, name):
    got = CORE.queries[name](spark, data)
    assert "Join" not in plan(got)
    want = JOINS[name](parsed(spark, data))
    assert sorted(got.columns) == sorted(want.columns) and dict(got.dtypes) == dict(want.dtypes)
    both = lambda d: sorted(tuple(r) for r in d.select(*want.columns).collect())
    assert both(got) == both(want) and got.count()


SEGMENTS = "seg_uid bigint, policy_id string, segment_id int, tokens array<string>, lang string, loaded_at timestamp"


@pytest.mark.parametrize("name", JOINS)
def test_odd_segments(spark, tmp_path, name):
    said = "We use personal data such as names and\n emails to send ads for analytics . \t Do we ? such as".split(" ")
    odd = [(1, "p", 1, said, "en"), (1, "p", 2, [*said[:5], None, "", " ", *said[5:]], None), (2, None, 1, said, " EN-gb "), (3, "p", 3, [], "en"), (4, "p", 4, None, "en"), (5, "p", 5, said, "de"), (6, "p", None, ["?", ".", "!"], "und")]
    spark.createDataFrame([(*r, None) for r in odd], SEGMENTS).write.parquet(f"{tmp_path}/segments.parquet")
    want = JOINS[name](parsed(spark, str(tmp_path)))
    both = lambda d: sorted(tuple(r) for r in d.select(*want.columns).collect())
    got = both(CORE.queries[name](spark, str(tmp_path)))
    assert got == both(want) and got


@pytest.mark.parametrize("name", ["pattern_links", "rule_statements"])
@pytest.mark.parametrize("most", [1000, 1])
def test_every_edge_through_every_template(spark, tmp_path, name, most, monkeypatch):
    """Terms that begin with "data ", repeats, loops, and terms that look like signs or tokens of the templates."""
    from clauseweave.operators import policies as P

    monkeypatch.setattr(P, "MOST", most)
    ends = [("data broker", "data set"), ("we", "names"), ("data", "we"), ("broker", "?"), ("of", "some"), ("some", "not"), ("a", "a"), ("Data  Broker", "data set"), ("we", "partners"), ("x", "data")]
    kg = [(p, s, t, k) for p in ("p", "q") for k in ("SUBSUM", "COLLECT") for s, t in ends] + [("r", "one", "two", "SUBSUM"), ("s", "one", "two", "collect"), (None, "one", "two", "SUBSUM"), ("t", None, "two", "SUBSUM")]
    spark.createDataFrame(kg, "policy_id string, source string, target string, key string").selectExpr("*", "array('said') as text", "map('legal', array('x')) as purposes").write.parquet(f"{tmp_path}/kg_edges.parquet")
    assert most == 1 or "Join" not in plan(CORE.queries[name](spark, str(tmp_path)))
    same(CORE.queries[name], CORE.oracles[name], spark, str(tmp_path))
