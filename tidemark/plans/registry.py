"""Registers, versions, workflows and dependency graphs as queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import registry
from tidemark.plans.catalogue import query
from tidemark.sources.tables import table


@query("""
with v as (select user_id, ts as start, max(event_id) as v from events where event_type = 'signup' group by all), p as (select user_id, event_id, ts from events where event_type = 'purchase')
select p.user_id, p.event_id, v.v as version_value from p asof left join v on p.user_id = v.user_id and p.ts >= v.start""")
def version_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sign-up before each purchase: an interval join on a table of versions."""
    events = table(spark, sf_dir, "events")
    versions = events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("start"), F.col("event_id").alias("v"))
    bought = events.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return registry.as_of(bought, versions, "user_id", "ts", "start", "v").select("user_id", "event_id", "version_value")


@query("""
with o as (select o_custkey, o_orderkey, o_orderstatus, o_orderpriority, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as i from orders),
p as (select l_orderkey, list_distinct(list(l_linenumber % 4)) as v from lineitem group by 1), j as (select o.*, v from o join p on l_orderkey = o_orderkey),
c as (select b.o_orderkey, a.v as a, b.v as b, a.o_orderstatus as ta, b.o_orderstatus as tb, a.o_orderpriority as ea, b.o_orderpriority as eb from j a join j b on a.o_custkey = b.o_custkey and b.i = a.i + 1),
d as (select *, len(list_filter(b, lambda x: not list_contains(a, x))) as added, len(list_filter(a, lambda x: not list_contains(b, x))) as removed, len(list_intersect(a, b)) as retained from c)
select o_orderkey, added, removed, retained, case when added + removed > 0 then 'BREAKING' when ta <> tb then 'PHASE_IN' when trim(ea) <> trim(eb) then 'AMENDMENT' else 'CLARIFICATION' end as change from d""")
def version_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order of a customer against the one before it."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_linenumber") % 4).alias("v"))
    i = F.expr("row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)")
    own = table(spark, sf_dir, "orders").withColumn("i", i).join(lines, "o_orderkey")
    old = own.select("o_custkey", (F.col("i") + 1).alias("i"), F.col("v").alias("a"), F.col("o_orderstatus").alias("ta"), F.col("o_orderpriority").alias("ea"))
    new = own.select("o_custkey", "i", "o_orderkey", F.col("v").alias("b"), F.col("o_orderstatus").alias("tb"), F.col("o_orderpriority").alias("eb"))
    return registry.compare_versions(new.join(old, ["o_custkey", "i"])).select("o_orderkey", "added", "removed", "retained", "change")


@query("""
with c as (select p_partkey as id, p_brand || '/' || p_size as domain, ['mandatory', 'permitted', 'prohibited', 'permitted'][p_partkey % 4 + 1] as modality, case when p_partkey % 3 <> 0 then p_type end as parameter,
  p_retailprice as value, case when p_partkey % 5 = 0 then 'MAX' else 'MIN' end as operator, p_brand as regulator, p_partkey % 6 as date from part),
p as (select a.id as a, b.id as b, least(a.modality, b.modality) = 'mandatory' and greatest(a.modality, b.modality) = 'prohibited' as clash,
  coalesce(a.parameter = b.parameter and abs(a.value - b.value) > 0.00001, false) as differ, a.operator = 'MAX' or b.operator = 'MAX' as ceiling, a.regulator = b.regulator and a.date <> b.date as overlap
  from c a join c b on a.domain = b.domain and a.id < b.id)
select a, b, case when clash then 'MODALITY_CLASH' when differ then 'THRESHOLD' else 'OVERLAP' end as conflict, case when clash then 'CRITICAL' when differ and ceiling then 'CRITICAL' when differ then 'HIGH' else 'MEDIUM' end as severity
from p where clash or differ or overlap""")
def clause_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    modality = F.get(F.array(*map(F.lit, ("mandatory", "permitted", "prohibited", "permitted"))), (i % 4).cast("int"))
    rows = table(spark, sf_dir, "part").select(
        i.alias("id"), F.concat_ws("/", "p_brand", "p_size").alias("domain"), modality.alias("modality"), F.when(i % 3 != 0, F.col("p_type")).alias("parameter"),
        F.col("p_retailprice").alias("value"), F.when(i % 5 == 0, "MAX").otherwise("MIN").alias("operator"), F.col("p_brand").alias("regulator"), (i % 6).alias("date"),
    )
    pairs = registry.clause_pairs(rows, "id", "domain")
    return registry.clause_severity(pairs).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "conflict", "severity")


@query("""
with k as (select p_type as topic, (p_partkey % 5)::integer as a, (p_partkey % 7)::integer as b, min(p_partkey) as i from part where p_partkey % 5 < p_partkey % 7 group by all),
n as (select topic, a, b, ['STRICTER_A', 'STRICTER_B', 'EQUIVALENT', 'GAP'][i % 4 + 1] as delta, (0.9 + (i % 10) / 100.0)::double as confidence from k),
q as (select p_partkey, p_type as topic, (p_partkey % 7)::integer as a, (p_partkey % 5)::integer as b from part)
select p_partkey, coalesce(f.delta, case r.delta when 'STRICTER_A' then 'STRICTER_B' when 'STRICTER_B' then 'STRICTER_A' else r.delta end, 'EQUIVALENT') as delta, coalesce(f.confidence, r.confidence, 0.85)::double as confidence
from q left join n f on f.topic = q.topic and f.a = q.a and f.b = q.b left join n r on r.topic = q.topic and r.a = q.b and r.b = q.a""")
def harmonised(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, i = table(spark, sf_dir, "part"), F.col("p_partkey")
    five, seven = (i % 5).cast("int"), (i % 7).cast("int")
    known = part.filter(five < seven).groupBy(F.col("p_type").alias("topic"), five.alias("a"), seven.alias("b")).agg(F.min("p_partkey").alias("i"))
    delta = F.get(F.array(*map(F.lit, ("STRICTER_A", "STRICTER_B", "EQUIVALENT", "GAP"))), (F.col("i") % 4).cast("int"))
    known = known.select("topic", "a", "b", delta.alias("delta"), (F.lit(0.9) + (F.col("i") % 10) / 100).alias("confidence"))
    return registry.harmonise(part.select("p_partkey", F.col("p_type").alias("topic"), seven.alias("a"), five.alias("b")), known).select("p_partkey", "delta", "confidence")


@query("""
with r as (select distinct l_orderkey, l_returnflag, l_linenumber as m from lineitem), d as (select distinct l_orderkey, l_returnflag, l_linenumber as m from lineitem where l_quantity > 20),
c as (select r.l_orderkey, r.l_returnflag, count(*) as required, count(d.m) as completed from r left join d using (l_orderkey, l_returnflag, m) group by all)
select l_orderkey, l_returnflag, required, completed, round(completed / required, 4) as ratio, completed = required as exit_ready from c""")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("milestone", F.col("l_linenumber"))
    required = lines.select("l_orderkey", "l_returnflag", "milestone")
    return registry.stage_progress(required, lines.filter("l_quantity > 20"), "l_orderkey", "l_returnflag")


@query("""
with s as (select o_orderkey, (o_orderkey % 5)::integer as stage, case o_orderstatus when 'F' then 'COMPLETED' when 'P' then 'BLOCKED' else 'ACTIVE' end as status, o_totalprice > 100000 as ready, case when o_orderkey % 4 = 0 then o_orderpriority end as over from orders),
m as (select *, status = 'ACTIVE' and (ready or length(coalesce(over, '')) >= 10) as moved from s)
select o_orderkey, case when moved and stage < 4 then stage + 1 else stage end as next_stage, case when moved and stage >= 4 then 'COMPLETED' else status end as next_status, case when status <> 'ACTIVE' then 'REJECTED' when moved then 'ADVANCED' else 'BLOCKING_ISSUES' end as outcome from m""")
def stage_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "BLOCKED").otherwise("ACTIVE")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("stage"), status.alias("status"), (F.col("o_totalprice") > 100000).alias("ready"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("override"))
    return registry.advance(rows, last=4).select("o_orderkey", "next_stage", "next_status", "outcome")


@query("""
select event_id, case when ts > timestamp '2024-01-15 12:05:00' then 'future' when ts < timestamp '2024-01-14 12:00:00' then 'stale' end as refused from events""")
def event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.validated(table(spark, sf_dir, "events"), "2024-01-15 12:00:00").select("event_id", "refused")


_MAIL = """e as (select event_id, o_orderkey as message_id, event_type, ts, case event_type when 'view' then 'Delivered' when 'click' then 'soft_bounce' when 'error' then 'hard_bounce' when 'signup' then 'opened' else 'spam' end as event,
  value::integer::varchar as reason, case when user_id % 3 = 0 then ' U' || user_id || '@X.org' else 'u' || user_id || '@x.org' end as email from events join orders on o_orderkey = event_id % 500)"""


def _mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "Delivered").when(F.col("event_type") == "click", "soft_bounce").when(F.col("event_type") == "error", "hard_bounce").when(F.col("event_type") == "signup", "opened").otherwise("spam")
    user = F.col("user_id").cast("string")
    email = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit(" U"), user, F.lit("@X.org"))).otherwise(F.concat(F.lit("u"), user, F.lit("@x.org")))
    sent = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message_id"))
    own = table(spark, sf_dir, "events").withColumn("message_id", F.col("event_id") % 500).join(sent, "message_id")
    return own.select("event_id", "message_id", F.col("ts").alias("at"), kind.alias("event"), F.rint("value").cast("int").cast("string").alias("reason"), email.alias("email"))


@query(f"""with {_MAIL}, k as (select message_id, ts, event_id, case when event = 'Delivered' then 'DELIVERED' else 'BOUNCED' end as s, case event when 'soft_bounce' then 'Soft bounce: ' || reason when 'hard_bounce' then 'Permanent bounce: ' || reason end as note from e where event in ('Delivered', 'soft_bounce', 'hard_bounce')),
l as (select * from (select *, row_number() over (partition by message_id order by ts desc, event_id desc) as r from k) where r = 1)
select o_orderkey as message_id, coalesce(s, 'SENT') as status, note from orders left join l on message_id = o_orderkey""")
def delivery_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message_id"), F.lit("SENT").alias("status"))
    return registry.delivery_status(sent, _mail(spark, sf_dir))


@query(f"""with {_MAIL}, g as (select distinct lower(trim(email)) as gone from e where event in ('hard_bounce', 'spam')),
s as (select distinct user_id, 'U' || user_id || '@x.ORG' as email, user_id % 7 <> 0 as is_active from events)
select user_id, email, is_active and gone is null as is_active from s left join g on gone = lower(email)""")
def suppressed_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    subscriptions = users.select("user_id", F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("@x.ORG")).alias("email"), (F.col("user_id") % 7 != 0).alias("is_active"))
    return registry.suppressed(subscriptions, _mail(spark, sf_dir))


@query("""
with r as (select p_brand, p_size % 3 = 0 as v, case when p_size > 35 or p_brand like '%1' and p_size > 9 then 'PQC_READY' when p_size > 15 then 'HYBRID' when p_size > 8 then 'UNKNOWN_AUDIT_REQUIRED' when p_size > 3 or p_brand like '%1' then 'CLASSICAL_SECURE' else 'CLASSICAL_DEPRECATED' end as s from part),
c as (
  select p_brand, count(*) as total, count(*) filter (s = 'PQC_READY') as ready, count(*) filter (s = 'HYBRID') as hybrid, count(*) filter (s = 'CLASSICAL_DEPRECATED') as deprecated,
    count(*) filter (s = 'UNKNOWN_AUDIT_REQUIRED') as unknown, count(*) filter (v) as vulnerable, round(count(*) filter (v) / count(*), 4)::double as exposure,
    round((count(*) filter (s = 'PQC_READY') + 0.75 * count(*) filter (s = 'HYBRID')) / count(*) * 100, 2)::double as readiness from r group by 1)
select *, case when readiness >= 80 and deprecated = 0 then 'PHASE_3_QUANTUM_RESILIENT' when readiness >= 30 then 'PHASE_2_HYBRID_TRANSITION' else 'PHASE_1_INVENTORY' end as milestone from c""")
def readiness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, first = F.col("p_size"), F.col("p_brand").endswith("1")
    status = F.when((size > 35) | first & (size > 9), "PQC_READY").when(size > 15, "HYBRID").when(size > 8, "UNKNOWN_AUDIT_REQUIRED").when((size > 3) | first, "CLASSICAL_SECURE").otherwise("CLASSICAL_DEPRECATED")
    return registry.readiness(table(spark, sf_dir, "part").withColumns({"status": status, "weak": size % 3 == 0}), "p_brand", "status", "weak")


@query("""
select s_nationkey, count(distinct l_partkey) as mapped, (select count(distinct p_partkey) from part) as total, round(count(distinct l_partkey) / (select count(distinct p_partkey) from part), 6) as coverage
from lineitem join supplier on s_suppkey = l_suppkey group by 1""")
def control_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    pairs = lines.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    targets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    return registry.coverage(pairs, targets, "s_nationkey", "l_partkey")


@query("""
with h as (select date_trunc('hour', ts) as hour, count(*) as total, count(*) filter (event_type = 'error') as errors from events group by 1), r as (select *, errors / total / 0.3 as rate from h)
select hour::varchar as hour, round(greatest(0, 1 - rate), 6) as remaining, greatest(0, 1 - rate) < 0.1 or rate >= 14.4 as frozen from r""")
def budget_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return registry.budget_state(hours, target=0.7).select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "remaining", "frozen")


@query("""
select l_suppkey, ['COMPLIANT', 'WARNING', 'BREACH'][max(case when l_discount >= 0.09 and l_quantity > 40 then 2 when l_discount >= 0.08 then 1 else 0 end) + 1] as status from lineitem group by 1""")
def worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when((F.col("l_discount") >= 0.09) & (F.col("l_quantity") > 40), "BREACH").when(F.col("l_discount") >= 0.08, "WARNING").otherwise("COMPLIANT")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(registry.worst(["COMPLIANT", "WARNING", "BREACH"], status).alias("status"))


_NEEDS = "select p_partkey as node, unnest([p_partkey // 2, p_partkey // 3]) as needs from part where p_partkey >= 8"


@query(f"""
with recursive e as (select distinct node, needs from ({_NEEDS}) where node <> 600 union all select 601, 601),
n as (select p_partkey as node, p_partkey < 8 and p_partkey <> 5 as given, exists (select 1 from e where node = p_partkey) as needy from part),
bad as (select node from n where not given and not needy union select 601 union select e.node from e join bad on e.needs = bad.node),
w as (select node, 0 as tier from n where given union all select e.node, w.tier + 1 from w join e on e.needs = w.node anti join bad on bad.node = e.node)
select n.node, case when b.node is null then max(w.tier) when not n.given and not needy then 0 end::bigint as tier, case when n.given then 'PROVIDED' when not needy then 'MISSING' when b.node is not null then 'BLOCKED' else 'COMPUTED' end as state
from n left join w on w.node = n.node left join (select distinct node from bad) b on b.node = n.node group by n.node, n.given, needy, b.node""")
def evaluation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that need the parts of half and of a third of their number; one needs itself, one is missing."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    i = F.col("node")
    edges = nodes.filter("node >= 8 and node <> 600").select("node", F.explode(F.array(F.floor(i / 2), F.floor(i / 3))).alias("needs"))
    edges = edges.unionAll(spark.createDataFrame([(601, 601)], "node long, needs long"))
    return registry.evaluation_order(edges, nodes, nodes.filter("node < 8 and node <> 5"))


@query("""
with e as (select distinct 'n' || c_nationkey as src, 'm' || c_mktsegment as dst, 'has' as relation from customer)
select src, dst, relation, case when src = 'n7' then dst else src end as node from e where src = 'n7' or dst = 'n7' order by src, dst, relation limit 3""")
def subgraph_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"), F.concat(F.lit("m"), F.col("c_mktsegment")).alias("dst"), F.lit("has").alias("relation"))
    return registry.subgraph(edges, "n7", 3)


@query("""
with t as (select conv_id, turn, role, ' ' || lower(coalesce(text, '')) || ' ' as t from conversations),
c as (select conv_id, turn, role, contains(t, ' the ')::integer + contains(t, ' and ')::integer as en, contains(t, ' der ')::integer + contains(t, ' und ')::integer as de, contains(t, ' que ')::integer + contains(t, ' los ')::integer as es from t)
select conv_id, turn, role, case when en + de + es = 0 then 'general' when en >= de and en >= es then 'auditor' when de >= es then 'lawyer' else 'trader' end as persona from c""")
def personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = {"auditor": ["the", "and"], "lawyer": ["der", "und"], "trader": ["que", "los"]}
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", registry.keyword_class(F.col("text"), classes, "general").alias("persona"))


@query("select user_id, round(date_diff('second', max(ts), timestamp '2024-02-01 00:00:00') / 3600.0, 4)::double as stale_hours from events group by 1")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.unix_timestamp(F.max("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round((F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - last) / 3600, 4).alias("stale_hours"))


@query("""
with g as (select o_custkey from orders group by 1 having count(*) filter (o_orderstatus = 'F') > 5)
select l_orderkey, l_linenumber from lineitem join orders on o_orderkey = l_orderkey where o_custkey not in (select o_custkey from g)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of lines when customers and their orders go."""
    orders = table(spark, sf_dir, "orders")
    gone = orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n")).filter("n > 5")
    left = orders.join(gone, "o_custkey", "left_anti").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(left, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""
with s as (select c_custkey, c_nationkey from customer), c as (select o_orderkey, o_orderdate, c_nationkey from orders join customer on c_custkey = o_custkey where o_orderpriority = '1-URGENT'),
r as (select s.c_custkey, c.o_orderkey, row_number() over (partition by s.c_custkey order by c.o_orderdate desc, c.o_orderkey) as place from s join c using (c_nationkey)
  where not exists (select 1 from orders o where o.o_custkey = s.c_custkey and o.o_orderkey = c.o_orderkey))
select c_custkey, o_orderkey, place from r where place <= 10""")
def digest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest urgent orders of each customer's nation that the customer hasn't placed."""
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "orders")
    news = orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderdate", F.col("o_custkey").alias("c_custkey")).join(customers, "c_custkey").select("o_orderkey", "o_orderdate", "c_nationkey", F.col("c_custkey").alias("by"))
    # ten more than wanted of each nation are enough: a customer's own are left out of them
    order = F.expr("row_number() over (partition by c_nationkey order by o_orderdate desc, o_orderkey)")
    own = news.groupBy("by").count().agg(F.max("count")).first()[0] or 0
    few = news.withColumn("n", order).filter(F.col("n") <= 10 + own)
    met = customers.join(few, "c_nationkey").filter("by <> c_custkey")
    place = F.expr("row_number() over (partition by c_custkey order by o_orderdate desc, o_orderkey)")
    return met.withColumn("place", place).filter("place <= 10").select("c_custkey", "o_orderkey", "place")
