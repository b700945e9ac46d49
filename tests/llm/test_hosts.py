"""Platforms and owners among hosts."""

from clauseweave.llm.hosts import evidence_of
from clauseweave.llm.names import name_families, resolve_names


def tokens(found):
    return {(r.entity_id, r.token) for r in found.collect()}


def test_large_owner_keeps_its_hosts(spark):
    own = [(i, [f"h{i}.acme.example"]) for i in range(300)]
    let = [(1000 + i, [f"m{i}.cloud.example"]) for i in range(60)]
    stray = [(2000 + i, [f"s{i}.acme.example"]) for i in range(45)]
    d = spark.createDataFrame(own + let + stray, "entity_id long, domains array<string>")
    families = spark.createDataFrame([(i, "acme") for i, _ in own] + [(i, f"f{i}") for i, _ in let + stray], "entity_id long, family string")
    got = tokens(evidence_of(d, families))
    assert {i for i, _ in got} == {i for i, _ in own + stray}


def test_records_without_names_are_no_family(spark):
    d = spark.createDataFrame([(i, ["acme.example"]) for i in range(60)], "entity_id long, domains array<string>")
    assert len(tokens(evidence_of(d, spark.createDataFrame([(0, "acme")], "entity_id long, family string")))) == 60


def test_open_records_of_a_large_owner_find_their_kind(spark):
    """Fifty records of one firm on its host; one states no trade in a family of two trades."""
    rows = [(i, "Wevnok Fasridtix Media", ["wevnok.example"]) for i in range(50)] + [(90, "Wevnok Fasridtix", ["wevnok.example"]), (91, "Wevnok Fasridtix Games", ["games.example"])]
    d = spark.createDataFrame(rows, "entity_id long, name string, domains array<string>")
    names = d.select("entity_id", "name")
    known = name_families(names)
    kinds = {r.entity_id: r.kind for r in resolve_names(names, evidence_of(d.select("entity_id", "domains"), known[1]), known).collect()}
    assert kinds[90] == kinds[0] == "media" and kinds[91] == "games"
