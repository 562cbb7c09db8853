"""The versioned store against a plain one, with repeated and broken batches; observations on a table and on a stream that is started again."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources.versioned import VersionedStore
from tidemark.streaming import observations

SCHEMA = "k string, v string, n long"


def plain_history(batches):
    now, rows, opened = {}, [], {}
    for at, whole, batch in batches:
        given = {k: (v, n) for k, v, n in batch if k is not None}
        for k in list(now):
            if (whole and k not in given) or (k in given and given[k] != now[k]):
                rows.append((k, *now.pop(k), opened[k], at))
        for k, value in given.items():
            if k not in now:
                now[k], opened[k] = value, at
    return sorted([*rows, *((k, *v, opened[k], None) for k, v in now.items())], key=str)


def shown(store):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return sorted((tuple(r) for r in store.history().select("k", "v", "n", day("valid_from"), day("valid_to")).collect()), key=str)


def test_store_equals_plain_history(spark, tmp_path):
    rng = random.Random(6)
    batches = []
    for i in range(4):
        rows = {k: (k, rng.choice(["x", "y", None]), rng.choice([1, None])) for k in rng.sample("abcdefgh", 5)}
        batches.append((f"2024-01-0{i + 1}", i % 2 == 1, [*rows.values(), (None, "x", 1)]))
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    store = VersionedStore(spark, str(tmp_path / "s"), "k", df([]).schema)
    assert store.history().count() == 0 and store.ledger() == []
    for i, (at, whole, rows) in enumerate(batches):
        first = store.merge(df([*rows, *rows]), f"b{i}", at, whole=whole)
        assert store.merge(df(rows[:1]), f"b{i}", at, whole=True) == first and len(store.ledger()) == i + 1
    assert shown(store) == plain_history(batches)
    assert store.merge(df(batches[-1][2]), "again", "2024-01-09", whole=True) == {"new": 0, "changed": 0, "gone": 0}
    assert sorted(map(str, (r.k for r in store.as_of("2024-01-04 12:00:00").collect()))) == sorted(r[0] for r in shown(store) if r[4] is None)
    assert store.merge(df([]), "empty", "2024-01-10") == {"new": 0, "changed": 0, "gone": 0}
    with pytest.raises(ValueError):
        store.merge(df([]), "back", "2024-01-01")


def test_broken_batch_leaves_the_old_state(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", "x", 1)], SCHEMA)
    store = VersionedStore(spark, str(tmp_path / "s"), "k", df.schema)
    store.merge(df, "one", "2024-01-01")
    before = shown(store)

    def broken(entry):
        raise OSError("the writer is lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", broken)
        with pytest.raises(OSError, match="lost"):
            store.merge(df.withColumn("v", F.lit("y")), "two", "2024-01-02")
    assert shown(store) == before
    assert store.merge(df.withColumn("v", F.lit("y")), "two", "2024-01-02")["changed"] == 1


def test_of_two_writers_one_starts_again(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", "x", 1), ("b", "x", 1)], SCHEMA)
    one, two = (VersionedStore(spark, str(tmp_path / "s"), "k", df.schema) for _ in range(2))
    commit = one._commit

    def late(entry):
        if entry["number"] == 0:
            two.merge(df.filter("k = 'a'"), "other", "2024-01-01")
        return commit(entry)

    monkeypatch.setattr(one, "_commit", late)
    assert one.merge(df, "mine", "2024-01-02") == {"new": 1, "changed": 0, "gone": 0}
    assert [e["batch"] for e in one.ledger()] == ["other", "mine"] and len(shown(one)) == 2


def test_stream_into_the_store(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", None)], SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    store = VersionedStore(spark, str(tmp_path / "s"), "k", df.schema)
    for turn in range(2):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        # the second run has lost its checkpoint, so it gives the batch again
        store.follow(stream, str(tmp_path / f"state{turn}"), "2024-01-01").awaitTermination(120)
    assert len(store.ledger()) == 1 and [r[:3] for r in shown(store)] == [("a", "x", 1), ("b", "y", None)]


def made_events(n):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        at = 1_700_000_000 + i * 4000
        seen = at + rng.choice([0, 0, 5, 90_000, -200, -1000])
        rows.append((rng.choice([i, i, max(0, i - 3)]), rng.choice([1, 1, 2, None]), at, seen, rng.choice(["ok", "ok", "error"])))
    rows += [(None, 1, rows[0][2], rows[0][3], "ok"), (n + 1, 2, None, rows[-1][3], "ok")]
    return sorted(rows, key=lambda r: r[3])


def arrivals(df):
    timed = df.withColumn("ts", F.timestamp_seconds("ts")).withColumn("seen", F.timestamp_seconds("seen"))
    return observations.arrivals(timed, "user", "ts", "seen", F.col("kind") != "error")


EVENTS = "event_id long, user long, ts long, seen long, kind string"


def plain_observations(rows, rules):
    held, out = {}, []
    for i, user, at, seen, kind in sorted(rows, key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[2] is not None, r[2] or 0)):
        own = held.setdefault(user, [])
        if i is None or at is None:
            status = "invalid"
        elif i in {e[0] for e in own}:
            status = "repeated"
        else:
            status = "future" if at > seen + rules.skew else "stale" if at < seen - rules.hours * 3600 else "accepted"
        if status == "accepted":
            own.append((i, at, kind))
        first = max((e[1] for e in own), default=0) // 86400 - rules.days + 1
        passes, fails = (sum(e[1] // 86400 >= first and (e[2] == "error") == bad for e in own) for bad in (False, True))
        out.append((i, user, status, passes, fails))
    return sorted(out, key=str)


def test_table_equals_plain_fold(spark):
    rows, rules = made_events(150), observations.Rules(days=2)
    found = observations.observe(arrivals(spark.createDataFrame(rows, EVENTS).repartition(4)), rules).collect()
    assert sorted(((r.event_id, r.key, r.status, r.passes, r.fails) for r in found), key=str) == plain_observations(rows, rules)
    assert {r.status for r in found} == {"invalid", "repeated", "future", "stale", "accepted"}
    assert observations.observe(arrivals(spark.createDataFrame([], EVENTS)), rules).count() == 0


def test_stream_equals_table_after_a_restart(spark, tmp_path):
    rows, rules = made_events(120), observations.Rules(days=2)
    schema = spark.createDataFrame([], EVENTS).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        made = observations.observe_stream(arrivals(stream), rules)
        query = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(180)

    for part in range(3):
        own = rows[part * 41 : (part + 1) * 41]
        spark.createDataFrame(own, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if part:
            run()
    key = lambda r: str(tuple(r))
    got = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=key)
    assert got == sorted(observations.observe(arrivals(spark.createDataFrame(rows, EVENTS)), rules).collect(), key=key) and len(got) == len(rows)


def test_state_survives_packing():
    own = observations.Observed()
    for i in range(200):
        own.take(observations.Rules(days=3), i, i * 3600 * 1_000_000, i * 3600 * 1_000_000, i % 5 > 0)
    assert observations.Observed.unpacked(*own.packed()) == own and len(own.days) == 3 and len(own.ids) <= 113
