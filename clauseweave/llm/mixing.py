"""Mixing sources to target weights (problem 9)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

BLOCKS = 1024


def temperature_weights(shares: list[float], exponent: float) -> list[float]:
    """Shares raised to ``exponent`` and normalised: 1 keeps them, 0 makes the non-empty ones equal."""
    p = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(p)
    return [x / total if total else 0.0 for x in p]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisect(f, low: float, high: float, steps: int = 80) -> float:
    """The largest argument for which the condition ``f``, true at ``low``, still holds."""
    if f(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) else (low, mid)
    return low


def exponent_for_entropy(shares: list[float], target: float) -> float:
    """The exponent in 0..1 whose weights have at least the entropy ``target`` (more as it falls)."""
    return bisect(lambda x: entropy(temperature_weights(shares, x)) >= target, 0.0, 1.0)


def plan(available: dict[str, int], targets: dict[str, float | None], repeats: dict[str, int], total: int | None = None) -> tuple[dict[str, int], float]:
    """(tokens to draw from each source, the temperature exponent).

    Each source gets its target share of ``total`` (by default the tokens of all listed sources), at
    most its tokens times its repetition limit. What sources without a target, and the room that
    short or empty sources leave, come to is shared by temperature weights: the sources' token
    shares raised to an exponent in 0..1. It is bisected to the largest one (the nearest to natural
    shares) at which the whole mix still has the entropy of the targets, as far as any exponent
    gives it, and no open source goes beyond its limit; a source that would is drawn to its limit, and
    the rest is shared anew. If all limits together are less than ``total``, all give what they may.
    """
    names = list(targets)
    limit = {s: available.get(s, 0) * max(0, repeats.get(s) or 0) for s in names}
    total = sum(available.get(s, 0) for s in names) if total is None else total
    asked = {s: max(0.0, t) * total for s, t in targets.items() if t is not None}
    wanted = [s for s in names if targets[s] is None or asked[s] > 0]
    if sum(limit[s] for s in wanted) <= total:
        return {s: limit[s] if s in wanted else 0 for s in names}, 1.0
    goal = entropy([t / total for t in asked.values()]) if len(asked) == len(names) and total else math.inf
    fixed: dict[str, float] = {s: float(limit[s]) for s in wanted if asked.get(s, 0.0) > limit[s] or not limit[s]}
    while True:
        open_ = [s for s in wanted if s not in fixed]
        left = total - sum(fixed.values()) - sum(asked.get(s, 0.0) for s in open_)
        size = sum(available[s] for s in open_)
        shares = [available[s] / size for s in open_]

        def mix(x: float) -> dict[str, float]:
            return fixed | {s: asked.get(s, 0.0) + left * w for s, w in zip(open_, temperature_weights(shares, x), strict=True)}  # noqa: B023

        def within(x: float) -> bool:
            return all(v <= limit[s] + 1e-6 for s, v in mix(x).items())  # noqa: B023

        most = max((x / 64 for x in range(65)), key=lambda x: entropy([v / total for v in mix(x).values()]))  # noqa: B023
        floor = min(goal, entropy([v / total for v in mix(most).values()]) - 1e-9)
        x = bisect(lambda x: entropy([v / total for v in mix(x).values()]) >= floor, most, 1.0)  # noqa: B023
        if not within(x) and within(most):
            x = bisect(within, most, x)
        over = [s for s in open_ if mix(x)[s] > limit[s] + 1e-6]
        if not over:
            got = mix(x)
            return {s: int(got.get(s, 0.0) + 1e-6) for s in names}, x
        fixed |= {s: float(limit[s]) for s in over}


def budgets(available: dict[str, int], targets: dict[str, float | None], repeats: dict[str, int], total: int | None = None) -> dict[str, int]:
    """Tokens to draw from each source; see ``plan``."""
    return plan(available, targets, repeats, total)[0]


def blocks_for(rows: int, of: int = 500_000) -> int:
    """Blocks of a permutation, so that each holds some ``of`` records at most; between 1,024 and 131,072."""
    return min(1 << 17, max(BLOCKS, -(-rows // of)))


def source_key(c):
    """A source's name for comparison: trimmed, lower case; blank is null."""
    k = F.lower(F.trim(c))
    return F.when(k != "", k)


def draw(sized: DataFrame, budget: dict[str, int], available: dict[str, int], seed: int = 0, blocks: int = BLOCKS) -> DataFrame:
    """(id, source, pass_no, block, order_key, tokens): the records drawn, one row for each time.

    sized: id, source (a ``source_key``), tokens. A budget is whole passes over the source and a part
    of one more; each pass is a fresh permutation, by blocks of a hash. In the last pass blocks are
    taken while their sums fit, and only the block in which the budget ends is cut, record by record.
    Block sums are a small table (sources x passes x blocks), so no window ever holds a source; a
    record that would go past the budget is taken if at least half of it fits. No record is drawn
    twice in a pass. Records without tokens and of unlisted sources are never drawn.
    """
    spark = sized.sparkSession
    plan = [(s, int(b // available[s]), int(b % available[s])) for s, b in budget.items() if b > 0 and available.get(s, 0) > 0]
    if not plan:
        return sized.limit(0).select("id", "source", F.lit(0).alias("pass_no"), F.lit(0).alias("block"), F.lit(0).cast("bigint").alias("order_key"), "tokens")
    plans = F.broadcast(spark.createDataFrame(plan, "source string, whole int, rest bigint"))
    x = sized.where("tokens > 0").join(plans, "source")
    x = x.withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    x = x.withColumn("order_key", F.xxhash64("id", "pass_no", F.lit(seed))).withColumn("block", F.pmod("order_key", F.lit(blocks)).cast("int"))
    last = x.where("pass_no = whole and rest > 0")
    sums = last.groupBy("source", "block").agg(F.sum("tokens").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).fillna({"before": 0})
    last = last.join(F.broadcast(before), ["source", "block"])
    inside = last.where("before + s <= rest")
    edge = last.where("before < rest and before + s > rest")
    w = Window.partitionBy("source", "block").orderBy("order_key", "id").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("before", F.col("before") + F.coalesce(F.sum("tokens").over(w), F.lit(0))).where("before + tokens / 2 <= rest")
    cols = ["id", "source", "pass_no", "block", "order_key", "tokens"]
    return x.where("pass_no < whole").select(*cols).unionByName(inside.select(*cols)).unionByName(edge.select(*cols))
