"""Scores of rankings and paired comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The cumulative probabilities of a Poisson distribution of mean 1, from 0 on.
POISSON_CDF = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]


def group_scores(ranked: DataFrame, groups: DataFrame, key: str, item: str, *, k: int) -> DataFrame:
    """Recall, hit, reciprocal rank and nDCG of each key.

    ``ranked`` is (key, item, rank), ``groups`` (key, item, group), an item in one
    group; a group counts once, at its first item.
    """
    first = ranked.select(key, item, "rank").join(groups, [key, item]).groupBy(key, "group").agg(F.min("rank").alias("first"))
    inside = F.col("first") <= k
    found = first.groupBy(key).agg(F.count_if(inside).alias("covered"), F.sum(F.when(inside, 1 / F.log2(F.col("first") + 1)).otherwise(0.0)).alias("dcg"), F.min("first").alias("best"))
    asked = groups.groupBy(key).agg(F.count_distinct("group").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    covered = F.coalesce("covered", F.lit(0))
    return asked.join(found, key, "left").select(
        key,
        F.round(covered / F.col("n"), 6).alias("recall"),
        (covered > 0).alias("hit"),
        F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"),
    )


def threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """What refusing below each threshold does, from (score, answerable) rows."""
    each = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    refused = F.col("score") < F.col("threshold")
    bad, good = ~F.col("answerable"), F.col("answerable")
    return each.groupBy("threshold").agg(
        F.count_if(refused).alias("refused"),
        F.round(F.coalesce(F.try_divide(F.count_if(refused & bad), F.count_if(bad)), F.lit(0.0)), 6).alias("refusal_recall"),
        F.round(F.coalesce(F.try_divide(F.count_if(refused & good), F.count_if(good)), F.lit(0.0)), 6).alias("false_rejection"),
    )


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs in which just one of two boolean outcomes holds, and the corrected statistic."""
    only = rows.agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))
    gap = F.abs(F.col("only_a") - F.col("only_b")) - 1
    return only.withColumn("statistic", F.round(F.coalesce(F.try_divide(gap * gap, F.col("only_a") + F.col("only_b")), F.lit(0.0)), 6))


def multiclass_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labellings with any labels; only their different pairs meet."""
    counts = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    one = counts.groupBy("a").agg(F.sum("n").alias("x"))
    two = counts.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("y"))
    chance = one.join(two, "a").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    return total.crossJoin(chance).select("n", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def paired_bootstrap(rows: DataFrame, ident: str, delta: str, *, iterations: int = 100, confidence: float = 0.95) -> DataFrame:
    """Mean of paired differences and its percentile interval.

    Each row takes part in each iteration as often as a Poisson draw says, which a
    hash of (iteration, row) decides: rows are read once, their sums by iteration
    are all that is shuffled, and a lost task draws the same again.
    """
    draws = rows.select(F.col(delta).cast("double").alias("d"), F.col(ident).cast("string").alias("ident"), F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("turn"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("turn").cast("string"), "ident")), 1, 8), 16, 10).cast("double") / 4294967296.0
    times = sum(((u >= c).cast("int") for c in POISSON_CDF), F.lit(0))
    means = draws.select("turn", "d", times.alias("w")).groupBy("turn").agg(F.try_divide(F.sum(F.col("w") * F.col("d")), F.sum("w")).alias("mean"))
    tail = (1 - confidence) / 2
    low, high = int(tail * iterations), min(int((1 - tail) * iterations), iterations - 1)
    interval = means.agg(F.array_sort(F.collect_list(F.round("mean", 9))).alias("means"))  # one value an iteration
    whole = rows.agg(F.count("*").alias("n"), F.round(F.avg(delta), 6).alias("mean"))
    pick = lambda i: F.round(F.try_element_at("means", F.lit(i + 1)), 6)
    return whole.crossJoin(interval).select("n", "mean", pick(low).alias("low"), pick(high).alias("high"))
