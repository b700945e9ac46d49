"""Fuzzy containment of one sentence in another."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def partial_ratio(a: str, b: str) -> float:
    """0 to 100: the best likeness of the shorter text with a stretch of its length in the longer."""
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100.0
    m = SequenceMatcher(None, short, long, autojunk=False)
    best = 0.0
    for _, j, n in m.get_matching_blocks():
        if n * 8 < len(short) and best:
            continue
        s = max(0, j)
        for start in {max(0, s - len(short) + n), s, max(0, s - 1)}:
            part = long[start : start + len(short)]
            best = max(best, 2 * sum(k for *_, k in SequenceMatcher(None, short, part, autojunk=False).get_matching_blocks()) / (len(short) + len(part)))
    return 100.0 * best


def may_reach(a: str, b: str, cutoff: float) -> bool:
    """False only where ``partial_ratio`` is surely below ``cutoff``.

    A stretch of p letters with a likeness of f to a text of n >= p letters leaves n - f(n + p)/2 letters
    of the text and p - f(n + p)/2 of its own unmatched. A letter of the text breaks three of its n - 2
    pieces of three letters, one of the stretch two; that is most at the least p, fn/(2 - f), or at
    p = n. The rest stand in the stretch, so n letters of the longer text must hold as many.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, f = len(short), cutoff / 100
    need = n - 2 - max(3 * (n - n * f / (2 - f)), 5 * (1 - f) * n)
    if need <= 0:
        return True
    pieces = {short[i : i + 3] for i in range(n - 2)}
    hits = np.fromiter((long[j : j + 3] in pieces for j in range(len(long) - 2)), dtype=np.int64, count=len(long) - 2)
    sums = np.concatenate(([0], np.cumsum(hits)))
    width = min(n - 2, len(hits))
    return bool((sums[width:] - sums[:-width]).max() >= need - 1e-6)


def best_partial_matches(lefts: DataFrame, rights: DataFrame, left: str, right: str, group: str, cutoff: float, top: int) -> DataFrame:
    """Pairs within a group whose partial likeness reaches ``cutoff``, the ``top`` best of each left text (TXT-09).

    All pairs of a group are candidates; groups are documents, so their pairs grow with the corpus as
    its rows do. ``may_reach`` rules out most of them before the costly comparison. Null and empty
    texts match nothing.
    """
    a = lefts.where(F.col(left) != "").withColumn("_l", F.xxhash64(group, left)).dropDuplicates(["_l"])
    b = rights.where(F.col(right) != "").withColumn("_r", F.xxhash64(*rights.columns)).dropDuplicates(["_r"])

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([partial_ratio(p, q) if p in q or q in p or may_reach(p, q, cutoff) else 0.0 for p, q in zip(x, y, strict=True)], dtype="float64")

    pairs = a.join(b, group).withColumn("score", F.pandas_udf(score, "double")(left, right)).where(F.col("score") >= cutoff)
    w = Window.partitionBy("_l").orderBy(F.desc("score"), "_r")
    return pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n", "_l", "_r")
