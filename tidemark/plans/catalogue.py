"""The registered queries of the library's own operators and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import compliance, evaluation, retrieval
from tidemark.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""
with d as (select doc_id, unnest(string_split_regex(lower(text), '\\s+')) as term from documents),
tf as (select doc_id, term, count(*) as tf from d where term <> '' group by all),
len as (select doc_id, sum(tf) as dl from tf group by all),
st as (select count(*) as n, avg(dl) as avgdl from len),
df as (select term, count(*) as df from tf group by all),
q as (select distinct item_id, unnest(string_split_regex(lower(text), '\\s+')) as term from benchmark),
s as (select item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
      from q join tf using (term) join df using (term) join len using (doc_id), st where term <> '' group by all),
r as (select item_id, doc_id, round(score, 6) as score, row_number() over (partition by item_id order by round(score, 6) desc, doc_id) as rank from s)
select item_id, doc_id, score, rank from r where rank <= 10""")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return retrieval.bm25(items, docs, k=10)


@query("""
with p as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders),
t as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders),
u as (select * from p where r <= 20 union all select * from t where r <= 20),
f as (select o_custkey, o_orderkey, round(sum(1.0 / (60 + r)), 9) as score from u group by all)
select o_custkey, o_orderkey, score, rank from (select *, row_number() over (partition by o_custkey order by score desc, o_orderkey) as rank from f) where rank <= 5""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    arms = [retrieval.ranked(orders, "o_custkey", [F.desc(c), F.asc("o_orderkey")], 20).select("o_custkey", "o_orderkey", "rank") for c in ("o_totalprice", "o_orderdate")]
    return retrieval.reciprocal_rank_fusion(arms, "o_custkey", "o_orderkey", k=5)


@query("""
with q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 50 = 0),
s as (select query_id, vec_id, round(list_dot_product(e::double[], embedding::double[]) / (sqrt(list_dot_product(e::double[], e::double[])) * sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) as score
      from q, embeddings where vec_id <> query_id)
select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""")
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.cosine_top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, k=5)


@query("""
select o_orderkey, o_custkey, o_orderstatus from orders
where o_orderdate <= timestamp '1997-01-01' and o_orderstatus in ('F', 'O') and (o_totalprice >= 1000 or o_orderpriority is null)""")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = (F.col("o_orderdate") <= F.lit("1997-01-01").cast("timestamp")) & F.col("o_orderstatus").isin("F", "O")
    keep &= (F.col("o_totalprice") >= 1000) | F.col("o_orderpriority").isNull()
    return table(spark, sf_dir, "orders").filter(keep).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("select sha256(text) as sha, count(*) as copies, min(doc_id) as first_doc from documents group by 1 having count(*) > 1")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return found.filter("copies > 1")


@query("""
with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events)
select event_type, round(avg(value), 6) as mean, max(value) filter (i = n // 2) as upper_median,
  max(value) filter (i = cast(ceil(0.95 * n) as bigint) - 1) as p95, max(value) as highest from r group by 1""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latency_summary(table(spark, sf_dir, "events"), "event_type", "value")


@query("""
with b as (select least(cast(floor(l_discount * 10 * 10) as bigint), 9) as bin, l_discount * 10 as conf, case when l_returnflag = 'R' then 1.0 else 0.0 end as hit from lineitem)
select bin, count(*) as n, round(avg(conf), 6) as confidence, round(avg(hit), 6) as accuracy, round(abs(avg(hit) - avg(conf)), 6) as gap from b group by 1""")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("confidence"), (F.col("l_returnflag") == "R").cast("double").alias("outcome"))
    return evaluation.calibration_bins(rows, 10)


@query("""
with c as (select count(*)::double as n, count(*) filter (quality = toxic)::double as same, sum(quality)::double as a, sum(toxic)::double as b from labels),
p as (select n, same / n as po, (a * b + (n - a) * (n - b)) / (n * n) as pe from c)
select cast(n as bigint) as n, round(po, 9) as observed, round(pe, 9) as expected, round((po - pe) / (1 - pe), 9) as kappa from p""")
def rater_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.cohens_kappa(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("""
with s as (select quality, n_chars as score from labels join documents using (doc_id)),
c as (select score, count(*) filter (quality = 1) as pos, count(*) filter (quality = 0) as neg from s group by 1),
w as (select pos, neg, sum(neg) over (order by score) - neg as below from c)
select round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 9) as auc, cast(sum(pos) as bigint) as positives, cast(sum(neg) as bigint) as negatives from w""")
def separation_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluation.separation_auc(rows.select((F.col("quality") == 1).alias("positive"), F.col("n_chars").alias("score")))


@query("""
with w as (select user_id, count(*) as total, count(*) filter (event_type <> 'error') as passed from events
           where ts >= timestamp '2024-01-10' and ts <= timestamp '2024-01-30' group by 1)
select user_id, total, passed, round(100.0 * passed / total, 2) as pct, case when 100.0 * passed / total >= 99 then 'COMPLIANT' else 'NON_COMPLIANT' end as status from w""")
def observation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.observation_status(table(spark, sf_dir, "events"), "2024-01-10", "2024-01-30")


@query("""
with d as (select user_id, cast(ts as date) as day, bool_and(event_type <> 'error') as ok from events group by all),
l as (select user_id, max(day) as last from d group by 1),
r as (select d.user_id, day, ok, date_diff('day', day, last) as back, row_number() over (partition by d.user_id order by day desc) - 1 as i from d join l using (user_id)),
s as (select *, count(*) filter (not ok or back <> i) over (partition by user_id order by day desc rows unbounded preceding) as broken from r)
select user_id, count(*) filter (broken = 0) as streak from s group by 1""")
def pass_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.pass_streak(table(spark, sf_dir, "events"))


@query("""
with recursive e as (select event_id, user_id, epoch_us(ts) as moment, row_number() over (partition by user_id order by ts, event_id) as i from events),
r as (select event_id, user_id, i, [moment] as held, true as allowed, 2 as remaining from e where i = 1 union all
  select e.event_id, e.user_id, e.i, case when len(k) < 3 then list_append(k, e.moment) else k end, len(k) < 3, case when len(k) < 3 then 2 - len(k) else 0 end
  from (select r.user_id, r.i, e.moment as now, list_filter(r.held, lambda x: x > e.moment - 86400000000) as k from r join e on e.user_id = r.user_id and e.i = r.i + 1) p join e on e.user_id = p.user_id and e.i = p.i + 1)
select event_id, user_id, allowed, remaining from r""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.sliding_log(table(spark, sf_dir, "events"), seconds=86400, limit=3)


@query("""
with h as (select date_trunc('hour', ts) as hour, count(*) as total, count(*) filter (event_type = 'error') as errors from events group by 1)
select hour, total, errors, round(errors / total::double / 0.005, 6) as burn_rate from h""")
def error_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.burn_rate(table(spark, sf_dir, "events"), target=0.995)


@query("select c_custkey, c_mktsegment from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def undelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return customers.join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("""
with v as (select version, start, lead(start) over (order by start) as stop from (values (1, timestamp '1993-01-01'), (2, timestamp '1995-01-01'), (3, timestamp '1997-01-01')) t(version, start))
select o_orderkey, coalesce((select version from v where o_orderdate >= start and (stop is null or o_orderdate < stop)), 1) as version from orders""")
def version_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = {1: "1993-01-01", 2: "1995-01-01", 3: "1997-01-01"}
    return compliance.version_as_of(table(spark, sf_dir, "orders"), "o_orderdate", starts).select("o_orderkey", "version")


@query("""
select a.p_partkey as a, b.p_partkey as b, abs(a.p_retailprice - b.p_retailprice) > 100 as differs
from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_size = b.p_size and a.p_partkey < b.p_partkey""")
def clause_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.conflicts(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], "p_partkey", "p_retailprice", 100)


@query("""
select source, doc_id, used from (select source, doc_id, sum(n_chars) over (partition by source order by doc_id rows unbounded preceding) as used from documents) where used <= 20000""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.pack_context(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars", 20000).select("source", "doc_id", "used")


@query("""
with r as (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) - 1 as r, count(*) over (partition by source) as n from documents)
select source, doc_id, case when n <= 2 then r when r % 2 = 0 then r // 2 else n - 1 - (r - 1) // 2 end as place from r""")
def context_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", (-F.col("n_chars")).alias("worse"))
    return retrieval.reorder_context(docs, "source", ["worse", "doc_id"]).select("source", "doc_id", "place")


@query("""
with w as (select doc_id, text, unnest(range(0, greatest(length(text) - 150, 1), 850)) as start from documents)
select doc_id, start, length(substring(text, start + 1, 1000)) as n_chars, md5(substring(text, start + 1, 1000)) as md5 from w""")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.windows(table(spark, sf_dir, "documents"), size=1000, overlap=150)


@query("""
select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) as emails, len(regexp_extract_all(text, '\\b\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b')) as addresses,
  len(regexp_extract_all(text, 'token = "[0-9a-f]{40}"')) as tokens from documents""")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"emails": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "addresses": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "tokens": r'token = "[0-9a-f]{40}"'}
    return table(spark, sf_dir, "documents").select("doc_id", *(F.regexp_count("text", F.lit(p)).cast("long").alias(n) for n, p in rules.items()))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)")
def crossfoot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
select o_custkey, sum(case o_orderpriority when '1-URGENT' then 10 when '2-HIGH' then 5 when '3-MEDIUM' then 2 else 1 end * case o_orderstatus when 'O' then 1.0 when 'P' then 0.5 else 0.0 end)::double as debt from orders group by 1""")
def debt_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.debt_score(table(spark, sf_dir, "orders"))
