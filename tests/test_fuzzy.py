"""Fuzzy containment against brute force."""

import random

from clauseweave.operators.fuzzy import best_partial_matches, may_reach, partial_ratio

TEXTS = ["We may share your email address with our partners today.", "You can write to us at any time and we delete it.", "Cookies are small files that sites store on a device for later visits.", "no", "We sell."]


def damaged(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s))
        s = rng.choice([s[:i] + s[i + 1 :], s[:i] + "q" + s[i:], s[:i] + "q" + s[i + 1 :]]) or s
    return s


def test_damaged_and_short_sentences(spark):
    rng = random.Random(2)
    left = [("p", "we may share your emxil address with partners"), ("p", "your email address"), ("p", "no"), ("p", ""), ("p", None)]
    for t in TEXTS:
        for n in range(6):
            i = rng.randrange(max(1, len(t) - 12))
            left.append(("p", damaged(rng, t[i : i + rng.randrange(3, 60)], n)))
    left = sorted(set(left), key=str)
    right = [("p", i, t) for i, t in enumerate(TEXTS)] + [("p", 99, None), ("q", 100, TEXTS[0])]
    got = best_partial_matches(spark.createDataFrame(left, "g string, a string"), spark.createDataFrame(right, "g string, id int, b string"), "a", "b", "g", 90, 99)
    want = {(a, i) for _, a in left if a for g, i, b in right if b and g == "p" and partial_ratio(a, b) >= 90}
    assert {(r.a, r.id) for r in got.collect()} == want and ("your email address", 0) in want and any(partial_ratio(a, TEXTS[i]) < 100 for a, i in want)


def test_bound_rules_out_no_match():
    rng = random.Random(7)
    text = " ".join(TEXTS)
    for _ in range(3000):
        i, n = rng.randrange(len(text) - 5), rng.randrange(3, 90)
        a = damaged(rng, text[i : i + n], rng.randrange(1 + n // 6))
        b = text[max(0, i - rng.randrange(40)) : i + n - rng.randrange(8)]
        for c in (70, 90, 95):
            assert not (a and b and partial_ratio(a, b) >= c) or may_reach(a, b, c), (a, b, c)
