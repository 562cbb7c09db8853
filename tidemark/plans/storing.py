"""Registered queries of stores and of state, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.catalogue import query
from tidemark.sources.tables import shared_folder, table
from tidemark.sources.versioned import VersionedStore
from tidemark.streaming import observations


@query("""
with c as (select c_custkey, c_mktsegment as o, c_custkey % 5 <> 0 as b1, c_custkey % 3 = 0 as b2, c_custkey % 7 <> 0 as b3 from customer),
v as (select *, case when b1 then o end as v1, case when b2 then case when c_custkey % 2 = 0 then 'CHANGED' else o end when b1 then o end as v2 from c),
e as (
  select c_custkey, timestamp '2024-01-01' as t, v1 as segment from v where b1
  union all select c_custkey, timestamp '2024-02-01', v2 from v where v2 is not null and v2 is distinct from v1
  union all select c_custkey, timestamp '2024-03-01', o from v where b3 and v2 is distinct from o
  union all select c_custkey, timestamp '2024-03-01', null from v where not b3 and v2 is not null),
h as (select *, lead(t) over (partition by c_custkey order by t) as n from e)
select c_custkey, segment, strftime(t, '%Y-%m-%d') as valid_from, strftime(n, '%Y-%m-%d') as valid_to from h where segment is not null""")
def store_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers merged in three batches (the second one twice): some change, some come later, and the last batch is all there is."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    k = F.col("c_custkey")
    store = VersionedStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", "c_custkey", rows.schema)
    store.merge(rows.filter(k % 5 != 0), "first", "2024-01-01 00:00:00")
    for _ in range(2):
        store.merge(rows.filter(k % 3 == 0).withColumn("segment", F.when(k % 2 == 0, "CHANGED").otherwise(F.col("segment"))), "second", "2024-02-01 00:00:00")
    store.merge(rows.filter(k % 7 != 0), "third", "2024-03-01 00:00:00", whole=True)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return store.history().select("c_custkey", "segment", day("valid_from"), day("valid_to"))


@query("""
with a as (
  select event_id, user_id, ts, event_type, case event_id % 10 when 3 then ts + interval 30 hour when 5 then ts - interval 10 minute else ts end as seen from events
  union all select event_id, user_id, ts, event_type, ts + interval 1 hour from events where event_id % 7 = 0),
o as (
  select *, row_number() over (partition by user_id order by seen, event_id, ts) as i,
    case when ts > seen + interval 5 minute then 'future' when ts < seen - interval 24 hour then 'stale' else 'accepted' end as base from a),
f as (select *, min(i) filter (base = 'accepted') over (partition by user_id, event_id) as first from o),
s as (select *, case when i > first then 'repeated' else base end as status from f),
l as (select *, max(ts) filter (status = 'accepted') over (partition by user_id order by i) as latest from s),
n as (
  select l.event_id, l.user_id, l.status, l.i, count(b.i) filter (b.event_type <> 'error') as passes, count(b.i) filter (b.event_type = 'error') as fails
  from l left join l b on b.user_id = l.user_id and b.i <= l.i and b.status = 'accepted' and b.ts::date > l.latest::date - 3 group by all)
select event_id, user_id as key, status, passes, fails, case when passes + fails < 3 then 'INSUFFICIENT_DATA' when passes >= 0.75 * (passes + fails) then 'COMPLIANT' else 'NON_COMPLIANT' end as verdict from n""")
def observed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they arrive, a tenth a day late, a tenth ahead of its time, a seventh twice: which ones count, and each user's last three days."""
    events, k = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_id") % 10
    seen = F.when(k == 3, F.col("ts") + F.expr("interval 30 hours")).when(k == 5, F.col("ts") - F.expr("interval 10 minutes")).otherwise(F.col("ts"))
    twice = events.filter(F.col("event_id") % 7 == 0).withColumn("seen", F.col("ts") + F.expr("interval 1 hour"))
    every = events.withColumn("seen", seen).unionAll(twice)
    return observations.observe(observations.arrivals(every, "user_id", "ts", "seen", F.col("event_type") != "error"), observations.Rules(days=3, least=0.75))
