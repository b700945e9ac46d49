"""Filling containers of fixed capacity (problem 8).

Dynamic programming over the global size histogram chooses the length buckets that add the least
padding. Batches are then formed by bucket, on the histogram alone: best fit decreasing over bucket
sizes gives patterns (how many items of which buckets share a container) with multiplicities.
Items are numbered within their bucket and take the slot of their number.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from clauseweave.plans.session import stash

BUCKETS = 384
ROWS_PER_SALT = 100_000


def choose_buckets(sizes: np.ndarray, counts: np.ndarray, most: int = BUCKETS) -> np.ndarray:
    """Upper ends of at most ``most`` buckets with the least total padding, by dynamic programming.

    sizes ascending with their counts. A layer per bucket; within a layer the best split points are
    monotone, so each is found by divide and conquer, all mids of a level at once.
    """
    n = len(sizes)
    if n <= most:
        return sizes.copy()
    total = np.r_[0, np.cumsum(counts)].astype(float)
    mass = np.r_[0, np.cumsum(counts * sizes)].astype(float)
    s = np.r_[0, sizes].astype(float)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    back = np.zeros((most + 1, n + 1), np.int32)
    for k in range(1, most + 1):
        cur = np.full(n + 1, np.inf)
        level = [(1, n, 0, n - 1)]
        while level:
            j = np.array([(a + b) // 2 for a, b, _, _ in level])
            lo = np.array([c for _, _, c, _ in level])
            hi = np.minimum(np.array([d for _, _, _, d in level]), j - 1)
            width = hi - lo + 1
            start = np.r_[0, np.cumsum(width)[:-1]]
            i = np.arange(width.sum()) - np.repeat(start, width) + np.repeat(lo, width)
            jj = np.repeat(j, width)
            v = best[i] + s[jj] * (total[jj] - total[i]) - (mass[jj] - mass[i])
            low = np.minimum.reduceat(v, start)
            first = np.flatnonzero(v == np.repeat(low, width))
            owner = np.repeat(np.arange(len(j)), width)[first]
            at = np.zeros(len(j), np.int64)
            at[owner[::-1]] = i[first[::-1]]
            cur[j], back[k, j] = low, at
            level = [x for (a, b, c, d), m, o in zip(level, j, at, strict=True) for x in ((a, m - 1, c, int(o)), (m + 1, b, int(o), d)) if x[0] <= x[1] and x[2] <= min(x[3], (x[0] + x[1]) // 2 - 1)]
        best = cur
    ends, j = [], n
    for k in range(most, 0, -1):
        if j <= 0:
            break
        ends.append(int(s[j]))
        j = int(back[k, j])
    return np.array(sorted(ends))


def patterns(ends: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(containers, {bucket: items}) by best fit decreasing over bucket sizes, whole groups at a time."""
    free: dict[int, list[list]] = defaultdict(list)  # room left -> [containers, contents]
    rooms: list[int] = []

    def put(room: int, n: int, content: dict[int, int]) -> None:
        if not free[room]:
            insort(rooms, room)
        free[room].append([n, content])

    for b in sorted(range(len(ends)), key=lambda x: -ends[x]):
        size, left = ends[b], counts[b]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                full, part = divmod(left, per)
                if full:
                    put(capacity - per * size, full, {b: per})
                if part:
                    put(capacity - part * size, 1, {b: part})
                break
            room = rooms[at]
            group = free[room].pop()
            if not free[room]:
                rooms.pop(at)
            n, content = group
            per = min(room // size, left)
            use = min(n, left // per)
            if use < n:
                put(room, n - use, content)
            put(room - per * size, use, {**content, b: content.get(b, 0) + per})
            left -= use * per
    return [(n, c) for groups in free.values() for n, c in groups]


def pieces_of(sized: DataFrame, capacity: int) -> DataFrame:
    """(id, piece, first_token, tokens): an item whole, or, if it alone exceeds the capacity, cut into full pieces and a rest."""
    n = F.ceil(F.col("tokens") / F.lit(capacity)).cast("int")
    x = sized.where("tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    first = F.col("piece").cast("bigint") * F.lit(capacity)
    return x.select("id", "piece", first.alias("first_token"), F.least(F.lit(capacity), F.col("tokens") - first).cast("bigint").alias("tokens"))


def pack(sized: DataFrame, capacity: int, buckets: int = BUCKETS) -> DataFrame:
    """(container_id, id, piece, first_token, tokens) of items (id, tokens) in containers of ``capacity``.

    Every piece is in one container, no container exceeds its capacity, and an item is split only if
    it alone exceeds it. Items without tokens (null or empty) need no container and give no row.

    The driver sees only the histogram, which the capacity bounds, the patterns made from it and the
    counts of at most buckets x 1024 sub-groups.
    Numbers within a bucket are given in two steps, by salted sub-groups and their offsets, so a size
    that a third of all items share is numbered by many tasks.
    """
    items = stash(pieces_of(sized, capacity))
    spark = items.sparkSession
    by_size = items.groupBy("tokens").agg(F.count("*").alias("n")).toPandas().sort_values("tokens")
    kind = sized.schema["id"].dataType.simpleString()
    if not len(by_size):
        return spark.createDataFrame([], f"container_id bigint, id {kind}, piece int, first_token bigint, tokens bigint")
    sizes, n = by_size["tokens"].to_numpy(np.int64), by_size["n"].to_numpy(np.int64)
    ends = choose_buckets(sizes, n, buckets)
    own = np.searchsorted(ends, sizes)
    base, slots, used = 0, defaultdict(list), np.zeros(len(ends), np.int64)
    for k, content in patterns(ends.tolist(), np.bincount(own, n, len(ends)).astype(int).tolist(), capacity):
        for b, m in content.items():
            slots[b].append((int(used[b]), base, m))
            used[b] += k * m
        base += k
    table = {b: tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) for b, rows in slots.items()}
    salts = max(16, int(n.sum() // ROWS_PER_SALT))
    lookup = spark.createDataFrame(pd.DataFrame({"tokens": sizes, "bucket": own.astype(np.int32)}))
    items = items.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int")).join(F.broadcast(lookup), "tokens")
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # one row for each salt of a bucket
    sub = items.groupBy("bucket", "salt").agg(F.count("*").alias("n")).select("bucket", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    shared = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_ = shared.value
        seen: dict[tuple[int, int], int] = defaultdict(int)
        for df in batches:
            out = np.empty(len(df), np.int64)
            for (b, s), at in df.groupby(["bucket", "salt"]).indices.items():
                rank = int(df["offset"].iloc[at[0]]) + seen[b, s] + np.arange(len(at))
                seen[b, s] += len(at)
                start, first, per = table_[b]
                j = np.searchsorted(start, rank, side="right") - 1
                out[at] = first[j] + (rank - start[j]) // per[j]
            yield pd.DataFrame({"container_id": out, "id": df["id"], "piece": df["piece"], "first_token": df["first_token"], "tokens": df["tokens"]})

    rows = items.join(sub, ["bucket", "salt"]).repartition("salt").sortWithinPartitions("salt", "id", "piece")
    return rows.mapInPandas(place, f"container_id bigint, id {kind}, piece int, first_token bigint, tokens bigint")
