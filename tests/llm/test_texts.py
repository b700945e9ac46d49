import random

import numpy as np
import pandas as pd
import pytest

from clauseweave.llm import encoding as E, language as L, mixing as M, packing as K, residue as R, site_tree as S
from clauseweave.llm.tokens import count_tokens, encoding as tokenizer

CASES = ["{{ name }}", "Contact ${dpo_name} now.", "© <year>", "Last updated: |phone|", "Effective date: dd.mm.yyyy", "By using %s you agree.", "[insert company name here]", "Lorem ipsum dolor", "Pellentanda vivo sitiva dolorum", "abc abc abc", "404 Not Found", "Access denied. Reference 943b77-404a.", "Please enable JavaScript to view this page.", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "TODO: legal to confirm this paragraph", "HTTP 500", "The controller is undefined, registered in NaN."]
SOUND = ["", "   ", None, "If you turn off JavaScript in your browser, some of the privacy controls described here will not work.", "In this notice, words in square brackets [like these] are defined.", "The set {IMEI, serial number} is read only once.", "Up to 100% of reports [1] are read by machines, and <1% by people.", "Access is denied to staff members who do not need your address for their work.", "Where a field is undefined by law, we treat it like your gender.", "The short name <Acme Ltd> stands for all firms in annex 8.", "Write “DELETE #account” in the subject line.", "Terms | Privacy policy | Imprint", "y z" * 50_000, "nous disons «données d'usage»"]


@pytest.mark.parametrize("text", CASES)
def test_residue(text):
    assert R.kind_of(text)


@pytest.mark.parametrize("text", SOUND, ids=lambda t: str(t)[:20])
def test_no_residue(text):
    assert R.kind_of(text) is None


def test_residue_column(spark):
    df = spark.createDataFrame([(1, "{{x}}", "clash"), (2, None, "clash"), (3, "We sell nothing.", None)], "id int, name string, residue0 string")
    assert [r.residue for r in R.mark_residue(df).orderBy("id").collect()] == ["slot", None, None]
    assert R.mark_residue(df.limit(0)).count() == 0


NODE = "site string, page_id long, policy_id string, node_id int, parent_id int, ordinal int, path array<int>, role string, name string, level int, extra string"


def page(k, body, site="a.example"):
    top = [("document", None, None), ("section", 0, None), ("link", 1, "Home"), ("link", 1, "Pricing"), ("article", 0, None), ("heading", 4, "Privacy policy"), *[("text", 4, b) for b in body], ("section", 0, None)]
    foot = len(top) - 1
    rows_ = [*top, ("link", foot, "Imprint"), ("link", foot, "Sitemap"), ("text", foot, None), ("text", foot, "  ")]
    return [(site, k, f"p{k}", i, p, 0, [], r, n, 1 if r == "heading" else None, "x") for i, (r, p, n) in enumerate(rows_)]


def test_site_tree(spark):
    rng = random.Random(0)
    words = "we collect store share your address number history with partners for orders only when law allows".split()
    rows_ = [x for k in range(12) for x in page(k, [" ".join(rng.choices(words, k=12)) + "." for _ in range(5)])]
    df = spark.createDataFrame([*rows_, *rows_[:7]], NODE)
    j = S.judge_pages(df).toPandas()
    assert len(j) == 12 * 10 and set(j[j.noise].name) == {"Home", "Pricing", "Imprint", "Sitemap"}
    assert S.judge_pages(df.limit(0)).count() == 0


def test_style_tree_importance(spark):
    df = spark.createDataFrame([x for k in range(4) for x in page(k, [f"text number {'abcd'[k]}"])], NODE)
    t = S.style_tree(S.page_leaves(df)).toPandas()
    assert (t[t.name == "Home"].content.abs() < 1e-6).all() and (t[t.name.str.startswith("text")].content == 1).all() and (t.pages == 4).all()


def test_page_cut_across_batches():
    b = pd.DataFrame({"page_id": [1, 1, 2, 2, 2, 3], "x": range(6)})
    parts = list(S._pages(iter([b[:1], b[1:4], b[4:]])))
    assert [sorted(set(p.page_id)) for p in parts] == [[1], [2], [3]] and sum(map(len, parts)) == 6


@pytest.mark.parametrize("codec", ["cp1252", "cp437", "mac_roman", "cp1251"])
def test_utf8_misread(codec):
    word = "".join(chr(x) if codec == "cp1252" and False else bytes([x]).decode(codec, "replace") for x in "résumé".encode())
    if "�" not in word:
        assert any(r == "résumé" for r, _, _ in E.readings(word))


def test_twice_misread():
    once = "résumé".encode().decode("cp1252")
    assert any(r == "résumé" for r, _, _ in E.readings(once.encode().decode("cp1252")))


def test_garbled_documents(spark):
    sound = [(i, "Das Wort für Erklärung steht hier – und können wir прочитать это слово.", "de") for i in range(30)]
    bad = [(100, "Das Wort fÃ¼r ErklÃ¤rung", "de"), (101, "steht k�nnen wir", "de"), (102, "ïðî÷èòàòü ýòî ñëîâî", "ru"), (103, "caf&eacute; &amp; SÃO Ð Ž ±5 €3", "pt"), (104, None, None), (105, "", None)]
    df = spark.createDataFrame(sound + bad, "doc_id long, text string, core string")
    assert {r.doc_id for r in E.garbled_ids(df.select("doc_id", "text")).collect()} == {100, 101, 102}
    fixed = {r.doc_id: r.restored for r in E.restore(df.select("doc_id", "text")).collect()}
    assert fixed[100] == "Das Wort für Erklärung" and fixed[101] == "steht können wir" and fixed[102] == "прочитать это слово"
    assert E.garbled_ids(df.select("doc_id", "text").limit(0)).count() == 0


def test_viterbi_fills_lost_bytes():
    cost = {p: 1.0 for p in ("^k", "kö", "ön", "nn", "n$")}
    assert E.viterbi("k�nn", cost, "öü")[0] == "könn"


@pytest.mark.parametrize("said,want", [("EN", "en"), ("en_GB", "en"), ("eng", "en"), ("Deutsch", "de"), ("pt-BR", "pt"), (None, None), (" ", None), ("und", None), ("unknown", None), ("rus", "ru")])
def test_stated(said, want):
    assert L.stated_index(said) == want


SENT = {"en": "We share your address with the partners that you choose.", "de": "Wir geben Ihre Adresse nicht an die Partner weiter.", "fr": "Nous ne vendons pas votre adresse à nos partenaires.", "es": "Nunca vendemos su dirección a los socios de la empresa.", "ru": "Мы не передаём ваш адрес нашим партнёрам без согласия."}


def test_field_and_parts(spark):
    f = L.train(pd.DataFrame([(s + " " + s, k) for k, s in SENT.items()] * 20, columns=["text", "lang"]))
    post = f.posteriors([L.tokens(SENT["de"]), []])
    assert np.allclose(post[0].sum(1), 1, atol=1e-4) and len(post[1]) == 0
    df = spark.createDataFrame([(1, SENT["en"] + " " + SENT["de"], "x"), (2, "Kurz.", None), (3, None, None), (4, "", None), (5, (SENT["fr"].upper() + "\n") * 500, None)], "id long, text string, lang string")
    p = L.label_parts(df, f, ["id"]).toPandas()
    assert list(p[p.id == 1].lang) == ["en", "de"] and p[p.id == 1].full.all() and not p[p.id == 2].full.any() and set(p.id) == {1, 2, 5} and list(p[p.id == 5].lang) == ["fr"]
    first = p[p.id == 1].iloc[1]
    assert (SENT["en"] + " " + SENT["de"])[first["first"] : first["last"]] == SENT["de"]


def test_forward_backward_against_enumeration():
    f = L.Field()
    rng = np.random.default_rng(0)
    f.t = rng.normal(size=f.t.shape)
    e = rng.normal(size=(3, len(L.LANGS)))
    k = len(L.LANGS)
    total = np.zeros((3, k))
    for a in range(k):
        for b in range(k):
            for c in range(k):
                w = np.exp(e[0, a] + e[1, b] + e[2, c] + f.t[a, b] + f.t[b, c])
                total[0, a] += w
                total[1, b] += w
                total[2, c] += w
    assert np.allclose(f.posteriors([["a", "b", "c"]], [e])[0], total / total.sum(1, keepdims=True), atol=1e-6)


def test_buckets_against_brute_force():
    from itertools import combinations

    sizes, counts = np.array([3, 5, 9, 10, 20, 31]), np.array([7, 1, 4, 2, 9, 1])
    pad = lambda ends: sum(c * (min(e for e in ends if e >= s) - s) for s, c in zip(sizes, counts))
    best = min(pad([*c, 31]) for c in combinations(sizes[:-1], 2))
    assert pad(K.choose_buckets(sizes, counts, 3)) == best


def test_packing(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([0, 3, 7, 50, 64, 65, 200, 999]), "x") for i in range(600)] + [(1000 + i, 33, "same") for i in range(400)]
    p = K.pack(spark.createDataFrame(items, "id long, tokens long, bucket0 string").select("id", "tokens"), 64).toPandas()
    fill = p.groupby("container_id").tokens.sum()
    whole = p.groupby("id").tokens.sum()
    want = {i: n for i, n, _ in items if n}
    assert fill.max() <= 64 and dict(whole) == want and set(p[p.piece > 0].id) <= {i for i, n in want.items() if n > 64}
    assert len(fill) <= 1.25 * sum(want.values()) / 64 + 400 / 2
    assert K.pack(spark.createDataFrame([], "id long, tokens long"), 64).count() == 0


def test_patterns_place_all():
    ends, counts = [10, 20, 33, 60], [5, 1000, 77, 3]
    pats = K.patterns(ends, counts, 64)
    assert [sum(n * c.get(b, 0) for n, c in pats) for b in range(4)] == counts and all(sum(ends[b] * m for b, m in c.items()) <= 64 for _, c in pats)


def test_budgets():
    b = M.budgets({"a": 1000, "b": 100, "c": 0}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 3, "b": 2, "c": 9})
    assert b["b"] == 200 and b["c"] == 0 and 895 <= b["a"] <= 900
    assert M.budgets({}, {"a": 1.0}, {"a": 1}) == {"a": 0}
    t = M.budgets({"a": 900, "b": 100}, {"a": None, "b": None}, {"a": 1, "b": 3})
    assert t["b"] > 100 and sum(t.values()) == pytest.approx(1000, abs=2)
    assert M.entropy(M.temperature_weights([0.9, 0.1], M.exponent_for_entropy([0.9, 0.1], 0.6))) == pytest.approx(0.6, abs=1e-6)


def test_draws(spark):
    items = [(i, "a", 10) for i in range(300)] + [(1000 + i, "b", 7) for i in range(10)] + [(2000, "a", 0), (2001, None, 5)]
    df = spark.createDataFrame(items, "id long, source string, tokens long")
    d = M.draw(df, {"a": 1505, "b": 160, "none": 5}, {"a": 3000, "b": 70}, blocks=8).toPandas()
    got = d.groupby("source").tokens.sum()
    assert abs(got["a"] - 1505) <= 10 and abs(got["b"] - 160) <= 7 and d.groupby(["id", "pass_no"]).size().max() == 1 and d[d.source == "b"].groupby("id").size().max() == 3
    assert M.draw(df, {}, {}).count() == 0


def test_token_counts(spark):
    texts = ["", None, "We collect data.", "é" * 1000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(count_tokens(__import__("pyspark").sql.functions.col("t"))).collect()]
    assert got == [0, 0, len(tokenizer().encode_ordinary(texts[2])), len(tokenizer().encode_ordinary(texts[3]))]


@pytest.mark.parametrize(
    "text",
    ["{{ customer full legal registered company name here }}", "[full legal name company registered street city postal address]", "Write to undefined for a copy of your data.", "Ooops, that link is broken!", "La requête a échoué. Veuillez réessayer plus tard.", "Es ist ein Fehler aufgetreten (Fehlercode 503)", "Il servizio è temporaneamente non disponibile. Riprova più tardi.", "Sessão expirada. Inicie sessão novamente.", "Strona jest chwilowo niedostępna", "Ваша сессия истекла, войдите снова", "JavaScript must be enabled to view this content", "El servidor no responde", "Your content goes here", "Platzhaltertext"],
)
def test_residue_of_all_languages(text):
    assert R.kind_of(text)


@pytest.mark.parametrize("text", ["{{" * 20_000, "[insert " * 20_000, "%a " * 20_000, "<% " * 20_000, "lorem" * 20_000], ids=lambda t: t[:8])
def test_residue_is_linear(text):
    import time

    start = time.time()
    R.kind_of(text)
    assert time.time() - start < 5


def test_tree_decides(spark):
    """Without importances nothing is removed but controls: the branches go by what the host shares."""
    rng = random.Random(1)
    words = "we collect store share your address number history with partners for orders only when law allows".split()
    rows_ = [x for k in range(6) for x in page(k, [" ".join(rng.choices(words, k=12)) + "." for _ in range(5)])]
    j = S.judge_pages(spark.createDataFrame(rows_, NODE)).toPandas()
    assert set(j[j.noise].decided_by) == {"tree"} and set(j[j.noise].name) == {"Home", "Pricing", "Imprint", "Sitemap"}
    alone = S.judge_pages(spark.createDataFrame([x for x in rows_ if x[1] == 0], NODE)).toPandas()
    assert not alone.noise.any()


def test_nodes_without_order(spark):
    """Missing parents, loops of parents and repeated rows neither crash nor double a leaf."""
    rows_ = [("h", 1, "p", 0, None, 0, [], "document", None, None, ""), ("h", 1, "p", 1, 2, 0, [], "text", "a b", None, ""), ("h", 1, "p", 2, 1, 0, [], "text", "c", None, ""), ("h", 1, "p", 3, 99, 0, [], None, "lost", None, ""), ("h", 1, "p", 3, 99, 0, [], None, "lost", None, ""), (None, 2, None, 0, None, 0, [], "text", "x" * 100_000, None, "")]
    got = S.page_leaves(spark.createDataFrame(rows_, NODE)).toPandas()
    assert sorted(got.name.str[:4]) == ["lost", "xxxx"]


def test_switch_inside_a_sentence(spark):
    """A sentence is cut where its words' probabilities switch; a language beside the nine is "other"."""
    rows_ = [(f"{s} {s}", k) for k, s in SENT.items()] * 20
    f = L.train(pd.DataFrame(rows_, columns=["text", "lang"]))
    mixed = "Nous ne vendons pas votre adresse when you share your address with us."
    swedish = "Vi delar aldrig dina personuppgifter med andra utan ditt samtycke."
    df = spark.createDataFrame([(1, mixed), (2, swedish)], "id long, text string")
    p = L.label_parts(df, f, ["id"]).toPandas().sort_values(["id", "part"])
    assert list(p[p.id == 1].lang) == ["fr", "en"] and list(p[p.id == 2].lang) == ["other"]
    cut = p[p.id == 1].iloc[1]
    assert mixed[cut["first"] :].startswith(("adresse when", "when", "you"))


def test_unsure_sentence_takes_its_neighbours(spark):
    f = L.train(pd.DataFrame([(f"{s} {s}", k) for k, s in SENT.items()] * 20, columns=["text", "lang"]))
    texts = [[SENT["de"], "Qzx.", SENT["de"]]]
    verdicts = [L.judge(f, texts[0])]
    L.judge_in_text(f, texts, verdicts)
    assert [L.LANGS[v[0]] for v in verdicts[0]] == ["de", "de", "de"]
