"""Evaluation beyond single measures: slices, bands, abstention, calibration, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def means(scores: DataFrame, measures: Sequence[str], by: str | None = None) -> DataFrame:
    """Number and means of ``measures``, by a slice if one is named (null is "unknown"); no rows give zeros."""
    rows = scores if by is None else scores.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("unknown")))
    grouped = rows.groupBy(*([by] if by else []))
    return grouped.agg(F.count("*").alias("n"), *(F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in measures))


def band(value: Column, edges: Sequence[float] = (0.0, 0.5, 0.8, 1.01), names: Sequence[str] = ("low", "medium", "high")) -> Column:
    """The band of a share; bands hold their lower edge and not their upper one."""
    out = F.lit(None).cast("string")
    for low, high, name in zip(edges, edges[1:], names, strict=False):
        out = F.when((value >= low) & (value < high), name).otherwise(out)
    return out


def share_or(hits: Column, of: Column, empty: float) -> Column:
    return F.round(F.when(of > 0, hits / of).otherwise(empty), 6)


def abstention(rows: DataFrame, *, accuracy: float = 0.9, precision: float = 0.8, rejection: float = 0.1) -> DataFrame:
    """Refusal precision, selective accuracy and false rejection of (unanswerable, refused, correct), and the gate.

    Empty denominators give 1, 1 and 0; null flags count as false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    un, ref, ok = flag("unanswerable"), flag("refused"), flag("correct")
    n = rows.agg(
        F.count_if(un & ref).alias("right_refusals"), F.count_if(~un & ref).alias("false_refusals"), F.count_if(~un).alias("answerable"), F.count_if(~un & ~ref & ok).alias("right_answers")
    )
    refused, answered = F.col("right_refusals") + F.col("false_refusals"), F.col("answerable") - F.col("false_refusals")
    out = n.select(
        share_or(F.col("right_refusals"), refused, 1.0).alias("refusal_precision"),
        share_or(F.col("right_answers"), answered, 1.0).alias("selective_accuracy"),
        share_or(F.col("false_refusals"), F.col("answerable"), 0.0).alias("false_rejection"),
    )
    return out.withColumn("passed", (F.col("selective_accuracy") >= accuracy) & (F.col("refusal_precision") >= precision) & (F.col("false_rejection") <= rejection))


def bin_of(confidence: Column, bins: int) -> Column:
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))
    return F.least(F.floor(held * bins), F.lit(bins - 1)).cast("long")


def calibration_error(rows: DataFrame, bins: int) -> DataFrame:
    """(n, ece, mce): mean gap of confidence and outcome weighted by bin, and the largest gap; zeros without rows."""
    each = rows.groupBy(bin_of(F.col("confidence"), bins).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("confidence") - F.avg("outcome")).alias("gap"))
    total = F.sum("n")
    return each.agg(F.coalesce(total, F.lit(0)).alias("n"), F.round(F.coalesce(F.sum(F.col("n") * F.col("gap")) / total, F.lit(0.0)), 6).alias("ece"), F.round(F.coalesce(F.max("gap"), F.lit(0.0)), 6).alias("mce"))


def fit_calibrator(rows: DataFrame, bins: int) -> DataFrame:
    """(bin, calibrated): the hit rate of each bin, an empty bin's middle, and one pass that pools neighbours which fall.

    The pass goes up the bins once; a bin below its neighbour takes with it the
    mean of both, as the values then stand.  ``bins`` rows.
    """
    spark = rows.sparkSession
    rates = rows.groupBy(bin_of(F.col("confidence"), bins).alias("bin")).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("outcome"))).alias("rate"))
    every = spark.range(bins).withColumnRenamed("id", "bin").join(rates, "bin", "left")
    filled = every.select("bin", F.coalesce("rate", (F.col("bin") + 0.5) / bins).alias("rate"))
    listed = filled.agg(F.array_sort(F.collect_list(F.struct("bin", "rate"))).alias("all")).select(F.col("all.rate").alias("rates"))

    def step(done: Column, rate: Column) -> Column:
        last = F.element_at(done, -1)
        pooled = (last + rate) / 2
        return F.when((F.size(done) > 0) & (rate < last), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(pooled, pooled))).otherwise(F.concat(done, F.array(rate)))

    start = F.array().cast("array<double>")
    safe = F.aggregate("rates", start, lambda done, rate: F.when(F.size(done) == 0, F.array(rate)).otherwise(step(done, rate)))
    return listed.select(F.posexplode(safe).alias("bin", "calibrated")).select(F.col("bin").cast("long"), F.round("calibrated", 9).alias("calibrated"))


def regression_gate(runs: DataFrame, order: str, measure: str, *, last: int = 3, tolerance: float = 0.01) -> DataFrame:
    """Each run's measure against the mean of the ``last`` runs before it; it regresses when it is lower by more than ``tolerance``.

    The first run has no baseline and passes.  Runs are few (one a day or change).
    """
    before = Window.orderBy(order).rowsBetween(-last, -1)
    delta = F.round(F.col(measure) - F.avg(measure).over(before), 6)
    return runs.select(order, measure, delta.alias("delta"), F.coalesce(delta < -tolerance, F.lit(False)).alias("regressed"))


def noise_floor(current: DataFrame, baseline: DataFrame, key: str, measure: str, *, iterations: int = 1000) -> DataFrame:
    """(n, delta, half_width) of a paired bootstrap over the keys that both runs share.

    Rows are weighted by Poisson draws from hashes of (draw, key): each row makes
    its draws where it is and only sums by draw are shuffled.
    """
    own = current.select(key, F.col(measure).alias("a")).join(baseline.select(key, F.col(measure).alias("b")), key).select(key, (F.col("a") - F.col("b")).alias("d"))
    u = F.pmod(F.xxhash64("i", key), F.lit(1 << 30)) / float(1 << 30)
    edges, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(8):
        total += term
        edges.append(total)
        term /= k + 1
    weight = sum(((u >= e).cast("int") for e in edges), F.lit(0))
    draws = own.select(key, "d", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("i")).withColumn("w", weight)
    by = draws.groupBy("i").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("mean"))
    width = by.agg(((F.percentile("mean", F.lit(0.975)) - F.percentile("mean", F.lit(0.025))) / 2).alias("half_width"))
    return own.agg(F.count("*").alias("n"), F.avg("d").alias("delta")).join(F.broadcast(width))
