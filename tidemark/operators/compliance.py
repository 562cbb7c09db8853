"""Compliance analytics over event streams, versions and clauses."""

from __future__ import annotations

import collections

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.operators.folds import fold_sorted


def observation_status(events: DataFrame, start: str, end: str, *, threshold: float = 99.0) -> DataFrame:
    """Share of passed checks of each user in a closed window of time."""
    inside = events.filter(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    counted = inside.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("passed"))
    pct = 100.0 * F.col("passed") / F.col("total")
    return counted.select("user_id", "total", "passed", F.round(pct, 2).alias("pct"), F.when(pct >= threshold, "COMPLIANT").otherwise("NON_COMPLIANT").alias("status"))


def pass_streak(events: DataFrame) -> DataFrame:
    """Days without an error in a row, back from each user's last day; a day without events ends it."""
    days = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.bool_and(F.col("event_type") != "error").alias("ok"))
    window = W.Window.partitionBy("user_id").orderBy(F.desc("day"))
    back = F.datediff(F.first("day").over(window), "day")
    placed = days.select("user_id", "day", "ok", back.alias("back"), (F.row_number().over(window) - 1).alias("i"))
    broken = F.count_if(~F.col("ok") | (F.col("back") != F.col("i"))).over(window.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow))
    return placed.withColumn("broken", broken).groupBy("user_id").agg(F.count_if(F.col("broken") == 0).alias("streak"))


def sliding_log(events: DataFrame, *, seconds: int, limit: int) -> DataFrame:
    """(event_id, user_id, allowed, remaining): a log of the last ``seconds`` of each user's allowed requests.

    A request is allowed while the log holds fewer than ``limit``; refused ones
    aren't recorded, and one is forgotten exactly ``seconds`` later.  Requests of
    the same moment go by their id.  A user's requests are sorted on disk and read
    once, so a task holds at most ``limit`` of them, however many there are.
    Rows without a time are refused.
    """

    def step(held: collections.deque, e: dict) -> tuple:
        while held and held[0] <= e["at"] - seconds * 1_000_000:
            held.popleft()
        free = len(held) < limit
        if free:
            held.append(e["at"])
        return e["event_id"], e["user_id"], free, limit - len(held) if free else 0

    timed = events.filter(F.col("ts").isNotNull()).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    kinds = {c: events.schema[c].dataType.simpleString() for c in ("event_id", "user_id")}
    found = fold_sorted(timed, "user_id", ["at", "event_id"], collections.deque, step, f"event_id {kinds['event_id']}, user_id {kinds['user_id']}, allowed boolean, remaining long")
    untimed = events.filter(F.col("ts").isNull()).select("event_id", "user_id", F.lit(False).alias("allowed"), F.lit(0).cast("long").alias("remaining"))
    return found.unionAll(untimed)


def burn_rate(events: DataFrame, *, target: float) -> DataFrame:
    """Errors by hour over the share of errors that the target allows."""
    hours = events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return hours.withColumn("burn_rate", F.round(F.col("errors") / F.col("total") / round(1 - target, 9), 6))


def version_as_of(rows: DataFrame, at: str, starts: dict[int, str]) -> DataFrame:
    """The version in force at each row's time; before the first one, the first."""
    newest = sorted(starts, key=starts.get, reverse=True)
    found = F.coalesce(*(F.when(F.col(at) >= F.lit(starts[v]).cast("timestamp"), v) for v in newest), F.lit(newest[-1]))
    return rows.withColumn("version", found)


def conflicts(clauses: DataFrame, keys: list[str], ident: str, value: str, tolerance: float) -> DataFrame:
    """Pairs of clauses on the same subject and whether their values differ by more than a tolerance."""
    a = clauses.select(*keys, F.col(ident).alias("a"), F.col(value).alias("x"))
    b = clauses.select(*keys, F.col(ident).alias("b"), F.col(value).alias("y"))
    return a.join(b, keys).filter("a < b").select("a", "b", (F.abs(F.col("x") - F.col("y")) > tolerance).alias("differs"))


def debt_score(orders: DataFrame) -> DataFrame:
    """Severity weights times the share still open, added up by customer."""
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", 10).when(F.col("o_orderpriority") == "2-HIGH", 5).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(1)
    status = F.when(F.col("o_orderstatus") == "O", 1.0).when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.0)
    return orders.groupBy("o_custkey").agg(F.sum(severity * status).alias("debt"))
