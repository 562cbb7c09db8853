"""Registers of rules, versions, workflows and dependencies, and what is decided from them."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import materialise


def as_of(rows: DataFrame, versions: DataFrame, key: str, at: str, start: str, value: str) -> DataFrame:
    """``rows`` with the ``value`` of the version of their key that began last at or before their time, else null.

    The versions of a key are few and go along with its rows as one array, so the rows of one key may be spread over
    any number of tasks; of versions that begin together the greatest value holds. Null keys have no versions.
    """
    begun = F.collect_list(F.struct(F.col(start).alias("begun"), F.col(value).alias("value")))
    known = versions.filter(F.col(start).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("versions_of")).agg(begun.alias("versions_"))
    last = F.array_max(F.filter("versions_", lambda v: v["begun"] <= F.col(at)))["value"]
    return rows.join(known, F.col(key) == F.col("versions_of"), "left").select(*rows.columns, last.alias("version_value"))


def compare_versions(pairs: DataFrame) -> DataFrame:
    """Add what changed from variables ``a`` to ``b`` and the kind of change.

    BREAKING for other variables, PHASE_IN for another threshold (``ta``, ``tb``),
    AMENDMENT for another expression (``ea``, ``eb``), else CLARIFICATION.
    """
    added, removed, kept = F.array_except("b", "a"), F.array_except("a", "b"), F.array_intersect("a", "b")
    kind = (
        F.when((F.size(added) > 0) | (F.size(removed) > 0), "BREAKING")
        .when(~F.col("ta").eqNullSafe(F.col("tb")), "PHASE_IN")
        .when(~F.trim("ea").eqNullSafe(F.trim("eb")), "AMENDMENT")
        .otherwise("CLARIFICATION")
    )
    return pairs.withColumns({"added": F.size(added), "removed": F.size(removed), "retained": F.size(kept), "change": kind})


#: Clauses of a domain that one task pairs with all of the domain, and pairs that a task looks at (about).
PAIRED_TOGETHER, PAIRS_A_TASK = 2_000, 20_000_000


def clause_pairs(clauses: DataFrame, key: str, domain: str) -> DataFrame:
    """The pairs of each domain's clauses, the smaller key first: their columns with ``_a`` and ``_b`` and, once, the domain.

    All pairs are made, so they grow with the square of a domain. A large domain is dealt to many tasks: some of its
    clauses go to each, all of the others go along. Null keys and domains have no pairs.
    """
    kept = clauses.filter(F.col(key).isNotNull() & F.col(domain).isNotNull())
    counts = materialise(kept.groupBy(domain).agg(F.count("*").alias("n")), "pairs-domains")
    # clauses are few beside their pairs, so that Spark by itself would leave them all to a few tasks
    pairs = counts.agg(F.sum(F.col("n") * F.col("n").cast("double"))).first()[0] or 0
    tasks = max(2 * clauses.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS_A_TASK))
    parts = counts.select(domain, F.ceil(F.col("n") / PAIRED_TOGETHER).cast("int").alias("_parts"))
    dealt = kept.join(parts, domain)
    sides = {x: [F.col(c).alias(f"{c}_{x}") for c in clauses.columns if c != domain] for x in "ab"}
    a = dealt.select(domain, *sides["a"], F.pmod(F.xxhash64(key), F.col("_parts")).cast("int").alias("_part"))
    b = dealt.select(domain, *sides["b"], F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    a, b = (x.repartition(tasks, domain, "_part") for x in (a, b))
    return a.join(b, [domain, "_part"]).filter(F.col(f"{key}_a") < F.col(f"{key}_b")).drop("_part")


def clause_severity(pairs: DataFrame) -> DataFrame:
    """Add type and severity of the conflict of two clauses of one domain; pairs without one go.

    Obligation against prohibition comes before different thresholds of one
    parameter (critical if either is a ceiling), and that before different dates
    of one regulator.
    """
    must, must_not = (lambda m, x=x: F.col(f"modality_{m}") == x for x in ("mandatory", "prohibited"))  # plain comparisons, as there are very many pairs
    clash = (must("a") & must_not("b")) | (must_not("a") & must("b"))
    differ = (F.col("parameter_a") == F.col("parameter_b")) & (F.abs(F.col("value_a") - F.col("value_b")) > 1e-5)
    ceiling = F.col("operator_a").isin("MAX", "<=") | F.col("operator_b").isin("MAX", "<=")
    overlap = (F.col("regulator_a") == F.col("regulator_b")) & (F.col("date_a") != F.col("date_b"))
    kind = F.when(clash, "MODALITY_CLASH").when(differ, "THRESHOLD").when(overlap, "OVERLAP")
    severity = F.when(clash, "CRITICAL").when(differ & F.coalesce(ceiling, F.lit(False)), "CRITICAL").when(differ, "HIGH").when(overlap, "MEDIUM")
    return pairs.withColumns({"conflict": kind, "severity": severity}).filter(F.col("conflict").isNotNull())


def harmonise(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Add classification and confidence of (topic, a, b): as known, else the reverse with its sides changed, else EQUIVALENT 0.85."""
    fwd = known.select("topic", "a", "b", F.col("delta").alias("d1"), F.col("confidence").alias("c1"))
    swapped = F.when(F.col("delta") == "STRICTER_A", "STRICTER_B").when(F.col("delta") == "STRICTER_B", "STRICTER_A").otherwise(F.col("delta"))
    back = known.select("topic", F.col("b").alias("a"), F.col("a").alias("b"), swapped.alias("d2"), F.col("confidence").alias("c2"))
    found = asked.join(fwd, ["topic", "a", "b"], "left").join(back, ["topic", "a", "b"], "left")
    return found.select(*asked.columns, F.coalesce("d1", "d2", F.lit("EQUIVALENT")).alias("delta"), F.coalesce("c1", "c2", F.lit(0.85)).alias("confidence"))


def stage_progress(required: DataFrame, done: DataFrame, subject: str, stage: str) -> DataFrame:
    """(subject, stage, required, completed, ratio, exit_ready) over milestones; a stage without any has ratio 1 and isn't ready."""
    hit = done.select(subject, stage, "milestone", F.lit(1).alias("hit")).distinct()
    rows = required.distinct().join(hit, [subject, stage, "milestone"], "left")
    counts = rows.groupBy(subject, stage).agg(F.count("milestone").alias("required"), F.count("hit").alias("completed"))
    ratio = F.when(F.col("required") == 0, 1.0).otherwise(F.round(F.col("completed") / F.col("required"), 4))
    return counts.withColumns({"ratio": ratio, "exit_ready": (F.col("required") > 0) & (F.col("completed") == F.col("required"))})


def advance(stages: DataFrame, *, last: int) -> DataFrame:
    """Add the next state of (stage, status, ready, override): one stage on where it may be left, COMPLETED behind the last.

    COMPLETED and BLOCKED stay; an override of at least 10 characters opens an
    exit that isn't ready.
    """
    open_ = F.col("status") == "ACTIVE"
    free = F.col("ready") | (F.length(F.coalesce("override", F.lit(""))) >= 10)
    moved = open_ & free
    return stages.withColumns(
        {
            "next_stage": F.when(moved & (F.col("stage") < last), F.col("stage") + 1).otherwise(F.col("stage")),
            "next_status": F.when(moved & (F.col("stage") >= last), "COMPLETED").otherwise(F.col("status")),
            "outcome": F.when(~open_, "REJECTED").when(moved, "ADVANCED").otherwise("BLOCKING_ISSUES"),
        }
    )


def validated(events: DataFrame, now: str, *, skew: int = 300, hours: int = 24) -> DataFrame:
    """Add why an event is refused, or null: no user, an unknown kind, in the future by more than ``skew`` seconds, older than ``hours``."""
    moment = F.lit(now).cast("timestamp")
    at = F.col("ts").cast("timestamp")
    reason = (
        F.when(F.col("user_id").isNull() | F.col("event_id").isNull(), "empty")
        .when(at.isNull(), "no time")
        .when(at > moment + F.make_dt_interval(secs=F.lit(skew)), "future")
        .when(at < moment - F.make_dt_interval(hours=F.lit(hours)), "stale")
    )
    return events.withColumn("refused", reason)


def delivery_status(deliveries: DataFrame, events: DataFrame) -> DataFrame:
    """(message_id, status, note) of each delivery after its events, the last one deciding; others keep their status."""
    kind = F.lower("event")
    status = F.when(kind == "delivered", "DELIVERED").when(kind.isin("soft_bounce", "bounced", "hard_bounce", "invalid_email"), "BOUNCED")
    note = F.when(kind.isin("soft_bounce", "bounced"), F.concat(F.lit("Soft bounce: "), F.coalesce("reason", F.lit("")))).when(kind.isin("hard_bounce", "invalid_email"), F.concat(F.lit("Permanent bounce: "), F.coalesce("reason", F.lit(""))))
    known = events.withColumns({"new": status, "note": note}).filter(F.col("new").isNotNull())
    last = known.groupBy("message_id").agg(F.max_by(F.struct("new", "note"), F.struct("at", "event_id")).alias("last"))
    return deliveries.join(last, "message_id", "left").select("message_id", F.coalesce("last.new", "status").alias("status"), "last.note")


def suppressed(subscriptions: DataFrame, events: DataFrame) -> DataFrame:
    """``subscriptions`` with those inactive whose address bounced for good, complained or unsubscribed, whatever its case."""
    gone = events.filter(F.lower("event").isin("hard_bounce", "invalid_email", "spam", "unsubscribe")).select(F.lower(F.trim("email")).alias("gone")).filter("gone <> ''").distinct()
    own = subscriptions.join(gone, F.lower(subscriptions["email"]) == gone["gone"], "left")
    return own.select(*(F.col(c) if c != "is_active" else (F.col(c) & F.col("gone").isNull()).alias(c) for c in subscriptions.columns))


def readiness(rows: DataFrame, by: str | None, status: str, vulnerable: str) -> DataFrame:
    """Counts of each group's assets by ``status``, their exposure (share of ``vulnerable`` ones), readiness and milestone.

    Readiness is the share of PQC_READY assets in per cent, HYBRID ones counted three quarters. The last milestone needs 80
    and no CLASSICAL_DEPRECATED asset, the second one 30. Without ``by`` there is one row, for no assets as well.
    """
    n, of = F.count("*"), lambda s: F.count_if(F.col(status) == s)
    counts = {"total": n, "ready": of("PQC_READY"), "hybrid": of("HYBRID"), "deprecated": of("CLASSICAL_DEPRECATED"), "unknown": of("UNKNOWN_AUDIT_REQUIRED"), "vulnerable": F.count_if(F.col(vulnerable))}
    found = rows.groupBy(*([by] if by else [])).agg(*(c.alias(name) for name, c in counts.items()))
    share = lambda x: F.coalesce(F.try_divide(x, F.col("total")), F.lit(0.0))
    found = found.withColumns({"exposure": F.round(share(F.col("vulnerable")), 4), "readiness": F.round(share(F.col("ready") + 0.75 * F.col("hybrid")) * 100, 2)})
    done = (F.col("readiness") >= 80) & (F.col("deprecated") == 0)
    return found.withColumn("milestone", F.when(done, "PHASE_3_QUANTUM_RESILIENT").when(F.col("readiness") >= 30, "PHASE_2_HYBRID_TRANSITION").otherwise("PHASE_1_INVENTORY"))


def coverage(pairs: DataFrame, targets: DataFrame, by: str, target: str) -> DataFrame:
    """Different mapped targets of each framework over all different targets."""
    total = targets.agg(F.count_distinct(target).alias("total"))
    return pairs.groupBy(by).agg(F.count_distinct(target).alias("mapped")).join(F.broadcast(total)).withColumn("coverage", F.round(F.col("mapped") / F.col("total"), 6))


def budget_state(hours: DataFrame, *, target: float, freeze_below: float = 0.1, fast: float = 14.4) -> DataFrame:
    """Add what is left of each hour's error budget and whether changes are frozen (too little left, or burnt too fast)."""
    rate = F.col("errors") / F.col("total") / round(1 - target, 9)
    left = F.greatest(F.lit(0.0), 1 - rate)
    return hours.withColumns({"remaining": F.round(left, 6), "frozen": (left < freeze_below) | (rate >= fast)})


def worst(statuses: Sequence[str], status: Column | str) -> Column:
    """The worst of a group's statuses, which are named from good to bad."""
    status = F.col(status) if isinstance(status, str) else status
    place = functools.reduce(lambda c, p: F.when(status == p[1], p[0]).otherwise(c), enumerate(statuses), F.lit(-1))
    return F.get(F.array(*map(F.lit, statuses)), F.max(place))


def evaluation_order(edges: DataFrame, nodes: DataFrame, given: DataFrame) -> DataFrame:
    """(node, tier, state) of a dependency graph of (node, needs).

    A node in ``given`` is PROVIDED; one without needs that isn't given is MISSING;
    one that needs, whatever the way, a missing node or one of a cycle is BLOCKED;
    others are COMPUTED, one tier behind the highest of what they need.  Each round
    settles a tier, so there are as many rounds as the graph is deep.
    """
    own = edges.filter("node is not null and needs is not null").distinct()
    base = nodes.join(given.select("node", F.lit(True).alias("given")), "node", "left").join(own.groupBy("node").agg(F.count("*").alias("n")), "node", "left")
    first = base.select("node", "n", F.when(F.col("given"), "PROVIDED").when(F.col("n").isNull(), "MISSING").alias("state"))
    settled = materialise(first.filter("state is not null").select("node", F.lit(0).cast("long").alias("tier"), "state"), "order-tier")
    waiting = materialise(own.join(first.filter("state is null").select("node", "n"), "node"), "order-waiting")
    while True:
        ready = waiting.join(settled.filter("state <> 'MISSING'").withColumnsRenamed({"node": "needs"}), "needs").groupBy("node").agg(F.count("*").alias("known"), F.first("n").alias("n"), (F.max("tier") + 1).alias("tier"))
        new = materialise(ready.filter("known = n").select("node", "tier", F.lit("COMPUTED").alias("state")).join(settled, "node", "left_anti"), "order-tier")
        if new.isEmpty():
            break
        settled = settled.unionAll(new)
    return nodes.join(settled, "node", "left").select("node", "tier", F.coalesce("state", F.lit("BLOCKED")).alias("state"))


def prerequisites(edges: DataFrame) -> DataFrame:
    """(node, tier, prerequisites) of (node, input): steps of the longest way from a node, and how many different nodes it needs in all.

    A round goes one step on from the different pairs that the round before has reached, so pairs are kept once a round
    however many ways lead from one to the other. Nodes without inputs have no row; a cycle raises ``ValueError``.
    """
    need = materialise(edges.select("node", "input").filter("node is not null and input is not null").distinct(), "prerequisites-needs")
    onward, at, tier = need.toDF("input", "next"), need, 1
    found = []
    while not at.isEmpty():
        if not at.filter("node = input").isEmpty():
            raise ValueError("a formula needs itself")
        found.append(at.withColumn("tier", F.lit(tier).cast("long")))
        at = materialise(at.join(onward, "input").select("node", F.col("next").alias("input")).distinct(), "prerequisites-pairs")
        tier += 1
    every = functools.reduce(DataFrame.unionAll, found or [at.withColumn("tier", F.lit(0).cast("long"))])
    return every.groupBy("node").agg(F.max("tier").alias("tier"), F.count_distinct("input").alias("prerequisites"))


def subgraph(edges: DataFrame, root: str, limit: int) -> DataFrame:
    """(src, dst, relation, node): the first ``limit`` edges at a node and who is at their other end."""
    own = edges.filter((F.col("src") == root) | (F.col("dst") == root)).distinct().orderBy("src", "dst", "relation").limit(limit)
    return own.withColumn("node", F.when(F.col("src") == root, F.col("dst")).otherwise(F.col("src")))


def keyword_class(text: Column, classes: dict[str, Sequence[str]], default: str) -> Column:
    """The class with the most of its words in a text, the first of equals; ``default`` without any."""
    low = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    counts = [F.struct(sum((F.when(low.contains(f" {w} "), 1).otherwise(0) for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (name, words) in enumerate(classes.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["name"]).otherwise(default)
