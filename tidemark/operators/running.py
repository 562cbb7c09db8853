"""Running sums over orders of any length: ranges are added up apart and then joined.

A window without a partition, or over a key that holds a third of all rows, sorts
in one task.  Here rows are dealt by ranges of (keys, order); only the sums of the
ranges are put in one order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.tables import materialise


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` (0 for null) up to each row of its keys, in ascending ``order``, which must be total.

    Null keys are a key of their own; an empty table stays empty.
    """
    placed = materialise(rows.repartitionByRange(*keys, *order).withColumn("range_of_rows", F.spark_partition_id()), "running-sum")
    by = [*keys, "range_of_rows"]
    sums = placed.groupBy(*by).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("of_range"))
    earlier = Window.partitionBy(*keys).orderBy("range_of_rows").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*(F.col(c).alias(f"{c}_") for c in by), F.coalesce(F.sum("of_range").over(earlier), F.lit(0)).alias("before"))
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.withColumn("upto", F.sum(F.coalesce(F.col(value), F.lit(0))).over(upto))
    same = [own[c].eqNullSafe(before[f"{c}_"]) for c in by]
    return own.join(before, same).select(*rows.columns, (F.col("upto") + F.col("before")).alias(name))
