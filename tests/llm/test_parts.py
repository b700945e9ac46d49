"""p2: what labels the parts of texts, and where."""

import numpy as np
from pyspark.sql import functions as F

from clauseweave.llm import language as L, query_language as Q, site_tree as S
from clauseweave.llm.encoding import damaged_words, garbled_ids
from clauseweave.plans.session import table


def test_documents_are_labelled_where_they_lie(spark, data):
    """Garbled documents are dropped after the labelling, so that no text is shuffled for it."""
    docs = Q.parts(spark, data)[0][0]
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan[: plan.index("MapInPandas")] and "LeftAnti" not in plan[plan.index("MapInPandas") :]
    bad = {r.doc_id for r in garbled_ids(table(spark, data, "documents")).collect()}
    assert bad and not bad & {r.record_id for r in docs.select("record_id").collect()}


def test_prose_is_judged_alone(spark, data):
    nodes = table(spark, data, "a11y_nodes")
    want = S.judge_pages(nodes).where("not noise and not residue and not heading and role not in ('heading', 'cell')")
    got = S.judge_pages(nodes, prose=True)
    key = ["page_id", "node_id", "name", F.round("importance", 9)]
    assert got.count() and not got.select(key).exceptAll(want.select(key)).count() and not want.select(key).exceptAll(got.select(key)).count()


def test_sequences_together_as_alone():
    """Steps over many sequences at once, of all lengths, give what each gives alone; so do the transitions."""
    rng = np.random.default_rng(1)
    f = L.Field()
    f.t = rng.normal(size=f.t.shape)
    k = len(L.LANGS)
    e = [rng.normal(size=(n, k)) * 4 for n in [0, 1, 2, 700, 3, 3, 12, 40, 1, 0, *range(5, 60)]]
    seqs = [["x"] * len(x) for x in e]
    got, trans = f.posteriors(seqs, e, pairs=True)
    want = np.zeros((k, k))
    for x, g in zip(e, got, strict=True):
        a, b = [], [np.ones(k)]
        for j, row in enumerate(np.exp(x)):
            a.append((row if not j else (a[-1] @ np.exp(f.t)) * row))
            a[-1] = a[-1] / a[-1].sum()
        for row in np.exp(x)[:0:-1]:
            y = np.exp(f.t) @ (row * b[0])
            b.insert(0, y / y.sum())
        for j, row in enumerate(np.exp(x)):
            p = a[j] * b[j]
            assert np.allclose(g[j], p / p.sum())
            if j + 1 < len(x):
                y = a[j][:, None] * np.exp(f.t) * (np.exp(x[j + 1]) * b[j + 1])
                want += y / y.sum()
        assert len(g) == len(x)
    assert np.allclose(trans, want)


def test_words_are_numbered_once(monkeypatch):
    """A field takes the features of each word once, however often it comes, and all numbers as 0."""
    f, seen = L.Field(), []
    real = L.word_features
    monkeypatch.setattr(L, "word_features", lambda w: seen.append(w) or real(w))
    for _ in range(2):
        flat, lens = f.numbered([L.raw_tokens("The 12 terms, the terms."), [], L.raw_tokens("terms 7")])
        assert [f.numbers.words[i] for i in flat] == ["the", "0", "terms", ",", "the", "terms", ".", "terms", "0"]
        assert list(lens) == [7, 0, 2] and list(f.letters[flat]) == [x.isalpha() for x in (f.numbers.words[i] for i in flat)]
    assert sorted(seen) == [",", ".", "0", "terms", "the"]


def test_sentence_ends():
    """The sign stays with its sentence, marks after it and line ends go, abbreviations and lower case don't end one."""
    assert L.sentences("A b.” C d! e f?\n\ng h.\ni Art. 5 J.") == ["A b.", "C d! e f?", "g h.", "i Art. 5 J."]
    assert L.sentences("\r\n.\n") == ["."] and L.sentences("") == []


def test_damaged_words_are_judged_once(spark):
    """The readings aren't computed again for the words that have none."""
    d = spark.createDataFrame([(1, "für"), (2, "für Ã¼ber"), (3, "fÃ¼r a\x81b")], "doc_id long, text string")
    bad = damaged_words(d)
    assert "MapInPandas" not in bad._jdf.queryExecution().optimizedPlan().toString()
    assert {r.core: r.reading for r in bad.collect()} == {"fÃ¼r": "für", "Ã¼ber": "über", "a\x81b": None}
