"""The token queries over whole tables."""

import pytest

from clauseweave.queries import CORE

PARSED = [
    "parsed_entity_spans", "parsed_subtree_bounds", "parsed_conjuncts", "parsed_sentence_texts", "parsed_such_as", "parsed_include", "parsed_subsumption", "parsed_coreference", "parsed_first_party", "parsed_purposes",
    "parsed_data_subjects", "parsed_negations", "parsed_statements", "phrase_stems",
]


@pytest.fixture(scope="module")
def tokens(spark, data):
    return CORE.queries["parsed_tokens"](spark, data).toPandas()


@pytest.mark.parametrize("name", PARSED)
def test_reads_all_segments(name, spark, data, tokens):
    got = {(r.doc, r.sent) for r in CORE.queries[name](spark, data).select("doc", "sent").distinct().collect()}
    all_ = set(zip(tokens["doc"], tokens["sent"], strict=True))
    assert got <= all_
    want = {
        "parsed_entity_spans": tokens[tokens.ent_iob != "O"],
        "parsed_subtree_bounds": tokens,
        "parsed_sentence_texts": tokens,
        "parsed_conjuncts": tokens[tokens.dep == "conj"],
        "phrase_stems": tokens[tokens.pos.isin(["NOUN", "PROPN"]) & ~tokens.dep.isin(["compound", "nmod"])],
        "parsed_negations": tokens[tokens.dep == "neg"],
    }.get(name)
    if want is not None:
        assert got == set(zip(want["doc"], want["sent"], strict=True))
