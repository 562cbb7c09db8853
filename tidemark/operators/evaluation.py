"""Statistics of retrieval quality and of raters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import running_sum


def latency_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, upper median, nearest-rank 95th percentile and maximum of each key.

    Rows are counted by value first, so a key's rows never meet in one task; null
    values take no part.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = running_sum(counts, [key], ["v"], "c", "upto")
    all_of = counts.groupBy(F.col(key).alias("key_")).agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.max("v").alias("highest"))
    at = upto.join(all_of, F.col(key).eqNullSafe(F.col("key_")))
    return at.groupBy(key).agg(
        F.round(F.first("mean"), 6).alias("mean"),
        F.min(F.when(F.expr("upto > n div 2"), F.col("v"))).alias("upper_median"),
        F.min(F.when(F.expr("upto >= ceil(0.95 * n)"), F.col("v"))).alias("p95"),
        F.first("highest").alias("highest"),
    )


def calibration_bins(rows: DataFrame, bins: int) -> DataFrame:
    """Equal-width bins of (confidence, outcome) with their gap between the two."""
    placed = rows.withColumn("bin", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("long"))
    confidence, accuracy = F.avg("confidence"), F.avg("outcome")
    return placed.groupBy("bin").agg(
        F.count("*").alias("n"), F.round(confidence, 6).alias("confidence"), F.round(accuracy, 6).alias("accuracy"), F.round(F.abs(accuracy - confidence), 6).alias("gap")
    )


def cohens_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two raters with 0/1 labels, and what chance would give."""
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"), F.sum(a).alias("a"), F.sum(b).alias("b"))
    chance = counts.select("n", (F.col("same") / F.col("n")).alias("po"), ((F.col("a") / F.col("n")) * (F.col("b") / F.col("n")) + (1 - F.col("a") / F.col("n")) * (1 - F.col("b") / F.col("n"))).alias("pe"))
    kappa = F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return chance.select("n", F.round("po", 9).alias("observed"), F.round("pe", 9).alias("expected"), F.round(kappa, 9).alias("kappa"))


def separation_auc(rows: DataFrame) -> DataFrame:
    """Probability that a positive row scores above a negative one, ties counted half.

    Rows are counted by score first, and the counts are added up by ranges of scores.
    """
    counts = rows.groupBy("score").agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    below = running_sum(counts, [], ["score"], "neg", "upto").withColumn("below", F.col("upto") - F.col("neg"))
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return below.agg(F.round(wins / (F.sum("pos") * F.sum("neg")), 9).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
