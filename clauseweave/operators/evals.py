"""Evaluation: precision and recall, coreference scores, edge statistics, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def precision_recall(truth: DataFrame, found: DataFrame, keys: list[str], label: str, group: str) -> DataFrame:
    """(group, tp, fp, fn, precision, recall), also over all groups ('all') (EVL-01, JON-03).

    truth: keys and ``label`` (1 or 0); found: keys. What is found without a label counts as wrong,
    what is labelled 1 and not found as missed. One full outer join, then grouping sets.
    """
    t = truth.select(*keys, F.coalesce(F.col(group).cast("string"), F.lit("none")).alias(group), F.col(label).alias("_y"))
    j = t.join(found.select(*keys).distinct().withColumn("_f", F.lit(1)), keys, "full")
    hit, wrong, missed = (F.col("_f") == 1) & (F.col("_y") == 1), (F.col("_f") == 1) & (F.coalesce("_y", F.lit(0)) == 0), F.col("_f").isNull() & (F.col("_y") == 1)
    g = j.withColumn(group, F.coalesce(group, F.lit("none"))).rollup(group).agg(F.count_if(hit).alias("tp"), F.count_if(wrong).alias("fp"), F.count_if(missed).alias("fn"))
    return g.select(F.coalesce(F.col(group).cast("string"), F.lit("all")).alias("grp"), "tp", "fp", "fn", F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 6).alias("prec"), F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), 6).alias("recall"))


def multilabel_metrics(df: DataFrame, truth: str, found: str) -> DataFrame:
    """(label, prec, recall, f1, support) of label arrays, and their means as 'macro' (EVL-11, AGG-16)."""
    each = df.select(F.explode(F.array_distinct(F.concat(truth, found))).alias("label"), truth, found)
    y, p = F.array_contains(truth, F.col("label")), F.array_contains(found, F.col("label"))
    m = each.groupBy("label").agg(F.count_if(y & p).alias("tp"), F.count_if(p).alias("np"), F.count_if(y).alias("support"))
    m = m.select("label", F.coalesce(F.col("tp") / F.nullif(F.col("np"), F.lit(0)), F.lit(0.0)).alias("prec"), F.coalesce(F.col("tp") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0)).alias("recall"), "support")
    m = m.withColumn("f1", F.coalesce(2 * F.col("prec") * F.col("recall") / F.nullif(F.col("prec") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))
    macro = m.agg(F.avg("prec").alias("prec"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support")).withColumn("label", F.lit("macro"))
    out = m.unionByName(macro)
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("prec", "recall", "f1")], "support")


def stratified_sample(df: DataFrame, group: str, order: list[str], n: int, seed: int = 0) -> DataFrame:
    """The same ``n`` rows of each group whatever the partitions: those whose hash comes first (EVL-08, SRT-08).

    The window keeps the first rows of each group before the shuffle, so a large group stays cheap.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in order]))
    w = Window.partitionBy(group).orderBy("_h", *order)
    return df.withColumn("_h", key).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n", "_h")


def coref_scores(gold: DataFrame, reach: DataFrame) -> DataFrame:
    """(app_id, mention, status): 'correct' if all gold antecedents of a mention are reachable, 'partial' if some (EVL-06, AGG-06)."""
    j = gold.join(reach.withColumn("_ok", F.lit(True)), ["app_id", "mention", "antecedent"], "left")
    ok = F.coalesce("_ok", F.lit(False))
    return j.groupBy("app_id", "mention").agg(F.when(F.bool_and(ok), "correct").when(F.bool_or(ok), "partial").otherwise("incorrect").alias("status"))
