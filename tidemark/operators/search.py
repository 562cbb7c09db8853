"""One search over several arms: metadata filters, fusion with edge bonuses, anchors and boosts.

A filter is a Column, so Catalyst pushes it into the scan; the arms are tables of
(query, document, rank) and meet in one grouped aggregation.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Multipliers of the tiers of authority, and of a tier that isn't known (fixed values).
TIERS = {1: 1.25, 2: 1.15, 3: 1.05, 4: 1.0, 5: 0.85}


@dataclass(frozen=True)
class MetadataFilter:
    """What a search is restricted to; ``None`` restricts nothing, an empty sequence lets nothing pass.

    Dates are closed intervals on ``coalesce(published, fetched)``; ``as_of`` takes
    what was published by then and not superseded yet.
    """

    sources: Sequence[str] | None = None
    tags: Sequence[str] | None = None
    published_from: str | None = None
    published_to: str | None = None
    as_of: str | None = None
    current: bool | None = None

    def predicate(self) -> Column:
        effective = effective_date()
        parts = [F.lit(True)]
        if self.sources is not None:
            parts.append(F.col("source").isin(*self.sources) if self.sources else F.lit(False))
        if self.tags is not None:
            parts.append(F.arrays_overlap("tags", F.array(*map(F.lit, self.tags))) if self.tags else F.lit(False))
        if self.published_from is not None:
            parts.append(effective >= F.lit(self.published_from).cast("date"))
        if self.published_to is not None:
            parts.append(effective <= F.lit(self.published_to).cast("date"))
        if self.as_of is not None:
            day = F.lit(self.as_of).cast("date")
            parts.append((effective <= day) & (F.col("superseded").isNull() | (F.col("superseded") > day)))
        if self.current is not None:
            parts.append(F.col("is_current") == F.lit(self.current))
        return functools.reduce(lambda a, b: a & b, parts)


def effective_date() -> Column:
    """The day of publication, or else of fetching."""
    return F.coalesce(F.col("published"), F.col("fetched").cast("date"))


def entitlement(tenant: str | None, clearance: int | None, sources: Sequence[str] | None = None) -> Column:
    """Rows that a caller may see; without a caller none.

    A row without a tenant or without a clearance is open to everybody.
    """
    if tenant is None and clearance is None:
        return F.lit(False)
    own = F.col("tenant").isNull() | (F.col("tenant") == F.lit(tenant))
    cleared = F.col("clearance").isNull() | (F.col("clearance") <= F.lit(clearance))
    return own & cleared & (F.lit(True) if sources is None else F.col("source").isin(*sources))


def tri_arm_fusion(arms: Mapping[str, DataFrame], query: str, doc: str, *, weights: Mapping[str, float] | None = None, rrf_k: int = 60) -> DataFrame:
    """(query, doc, score, arm_ranks): reciprocal ranks of all arms, an edge's score adding a tenth of itself.

    Arms hold ``query``, ``doc``, ``rank`` and may hold ``edge``; an arm of weight
    0 or less takes no part.  ValueError for ``rrf_k`` below 1 or weights that add
    up to nothing.
    """
    if rrf_k < 1:
        raise ValueError(f"rrf_k must be at least 1, not {rrf_k}")
    if weights is not None and sum(weights.values()) <= 0:
        raise ValueError("the weights must add up to more than 0")
    terms = []
    for arm, rows in arms.items():
        weight = (weights or {}).get(arm, 1.0)
        if weight > 0:
            bonus = 1 + 0.1 * F.coalesce(F.col("edge"), F.lit(0.0)) if "edge" in rows.columns else F.lit(1.0)
            terms.append(rows.select(query, doc, F.lit(arm).alias("arm"), "rank", (F.lit(weight) * bonus / (rrf_k + F.col("rank"))).alias("term")))
    found = functools.reduce(DataFrame.unionAll, terms)
    ranks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("arm", "rank"))), lambda x: F.concat_ws("=", x["arm"], x["rank"].cast("string"))), ",")
    return found.groupBy(query, doc).agg(F.round(F.sum("term"), 9).alias("score"), ranks.alias("arm_ranks"))


def top(found: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """The ``k`` best of each query with their ``rank``, ties to the smaller document."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), doc))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def anchor_arm_leaders(fused: DataFrame, leaders: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """The ``k`` best of each query, in which the first of each arm has a place.

    Leaders that are not among the best replace its tail, in the order of their
    ``arm``; a document that leads several arms is anchored once, by the first.
    ``fused`` holds query, doc, score; the result tells ``anchored_arm`` or null.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, not {k}")
    first = leaders.groupBy(query, doc).agg(F.min("arm").alias("arm"))
    own = Window.partitionBy(query)
    rows = fused.select(query, doc, "score").join(first, [query, doc], "full")
    place = F.row_number().over(own.orderBy(F.desc_nulls_last("score"), doc))
    rows = rows.withColumn("place", place).withColumn("best", (F.col("place") <= k) & F.col("score").isNotNull())
    rows = rows.withColumn("missing", F.col("arm").isNotNull() & ~F.col("best"))
    rows = rows.withColumn("kept", F.col("best") & (F.col("place") <= k - F.sum(F.col("missing").cast("int")).over(own)))
    n = F.row_number().over(Window.partitionBy(query, "missing").orderBy("arm", doc))
    rows = rows.withColumn("rank", F.when(F.col("kept"), F.col("place")).when(F.col("missing"), F.sum(F.col("kept").cast("int")).over(own) + n))
    found = rows.filter(F.col("rank") <= k)
    return found.select(query, doc, F.coalesce("score", F.lit(0.0)).alias("score"), F.col("rank").cast("int"), F.when(F.col("missing"), F.col("arm")).alias("anchored_arm"))


def authority_boost(score: Column | str, tier: Column | str) -> Column:
    """The score times the multiplier of its tier of authority; other tiers count as they are."""
    score, tier = (F.col(x) if isinstance(x, str) else x for x in (score, tier))
    factor = functools.reduce(lambda w, t: w.when(tier == t[0], t[1]), list(TIERS.items())[1:], F.when(tier == 1, TIERS[1]))
    return score * factor.otherwise(1.0)


def centrality(edges: DataFrame, target: str) -> DataFrame:
    """(target, centrality): how often each target is cited over how often the most cited one is."""
    cited = edges.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    most = cited.agg(F.max("n").alias("most"))
    return cited.join(F.broadcast(most)).select(target, F.round(F.col("n") / F.col("most"), 9).alias("centrality"))


def centrality_boost(score: Column | str, central: Column | str, weight: float = 0.15) -> Column:
    """score * (1 + w ln(1 + c (e - 1))), with w held to 0..0.3 and c to 0..1."""
    score, central = (F.col(x) if isinstance(x, str) else x for x in (score, central))
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(central, F.lit(0.0))))
    return score * (1 + min(0.3, max(0.0, weight)) * F.log1p(held * (F.exp(F.lit(1.0)) - 1)))


def conflict_margin(score: Column, own: Column, mentioned: Column, margin: float) -> Column:
    """The score less ``margin`` where a text mentions entities but none of the query's."""
    clash = (F.size(mentioned) > 0) & (F.size(own) > 0) & ~F.arrays_overlap(mentioned, own)
    return score - F.when(clash, F.lit(margin)).otherwise(0.0)


def page(rows: DataFrame, order: list[Column], *, size: int, number: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows, each with the ``total`` of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(size * number).limit(size).join(F.broadcast(total))


def listing(rows: DataFrame, equal: Mapping[str, object]) -> DataFrame:
    """The rows that equal all given values; ``None`` doesn't filter."""
    wanted = [F.col(c) == F.lit(v) for c, v in equal.items() if v is not None]
    return rows.filter(functools.reduce(lambda a, b: a & b, wanted)) if wanted else rows


def prefix_suggestions(keys: DataFrame, asked: DataFrame, *, limit: int) -> DataFrame:
    """(prefix, key, score, rank) of the keys that begin with each ``prefix``.

    An equal key counts 1.3 of its ``base``, a longer one 0.8 and a fifth of the
    share of it that the prefix is.  Keys are joined by their beginnings of the
    lengths that are asked for, so no pair of other keys is looked at.
    """
    clean = asked.select("prefix", F.lower(F.trim("prefix")).alias("p")).filter("p <> ''").distinct()
    own = keys.select(F.lower("key").alias("key"), "base").groupBy("key").agg(F.max("base").alias("base"))
    sizes = clean.agg(F.collect_set(F.length("p")).alias("sizes"))  # one row of a few lengths
    begins = own.join(F.broadcast(sizes)).select("key", "base", F.explode(F.filter("sizes", lambda n: n <= F.length("key"))).alias("n")).select("key", "base", F.col("key").substr(F.lit(1), F.col("n")).alias("p"))
    met = clean.join(begins, "p")
    part = F.length("p") / F.length("key")
    score = F.round(F.col("base") * F.when(F.col("key") == F.col("p"), 1.3).otherwise(0.8 + 0.2 * part), 6)
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("score"), "key"))
    return met.select("prefix", "key", score.alias("score")).withColumn("rank", rank).filter(F.col("rank") <= limit)
