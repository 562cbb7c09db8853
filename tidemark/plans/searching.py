"""Search queries: filters, arms, anchors, boosts, pages and suggestions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import retrieval, search
from tidemark.plans.catalogue import query
from tidemark.sources.tables import table

#: The catalogue of texts that the filters run on, derived from documents.
_CATALOGUE = """(select doc_id, source, n_chars, [lang, 'size' || (n_chars // 2000)::varchar] as tags,
  case when doc_id % 11 <> 0 then date '2023-01-01' + (doc_id * 7 % 700)::integer end as published,
  timestamp '2024-03-01 12:00:00' + to_days((doc_id % 90)::integer) as fetched,
  case when doc_id % 4 = 0 then date '2024-02-01' + (doc_id % 200)::integer end as superseded, doc_id % 4 <> 0 as is_current,
  case when doc_id % 5 <> 0 then 't' || (doc_id % 3)::varchar end as tenant, case when doc_id % 7 <> 0 then (doc_id % 4)::integer end as clearance from documents)"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        "n_chars",
        F.array(F.col("lang"), F.concat(F.lit("size"), F.floor(F.col("n_chars") / 2000).cast("string"))).alias("tags"),
        F.when(i % 11 != 0, F.date_add(F.lit("2023-01-01").cast("date"), (i * 7 % 700).cast("int"))).alias("published"),
        (F.lit("2024-03-01 12:00:00").cast("timestamp") + F.make_dt_interval((i % 90).cast("int"))).alias("fetched"),
        F.when(i % 4 == 0, F.date_add(F.lit("2024-02-01").cast("date"), (i % 200).cast("int"))).alias("superseded"),
        (i % 4 != 0).alias("is_current"),
        F.when(i % 5 != 0, F.concat(F.lit("t"), (i % 3).cast("string"))).alias("tenant"),
        F.when(i % 7 != 0, (i % 4).cast("int")).alias("clearance"),
    )


@query(f"""
select doc_id, coalesce(published, fetched::date)::varchar as effective from {_CATALOGUE}
where list_has_any(tags, ['en', 'size1']) and coalesce(published, fetched::date) between date '2023-06-01' and date '2024-04-15' and is_current""")
def tagged_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = search.MetadataFilter(tags=["en", "size1"], published_from="2023-06-01", published_to="2024-04-15", current=True)
    return catalogue(spark, sf_dir).filter(wanted.predicate()).select("doc_id", search.effective_date().cast("string").alias("effective"))


@query(f"""
select doc_id from {_CATALOGUE} where coalesce(published, fetched::date) <= date '2024-03-10' and (superseded is null or superseded > date '2024-03-10')""")
def as_of_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).filter(search.MetadataFilter(as_of="2024-03-10").predicate()).select("doc_id")


@query(f"select doc_id, tenant, clearance from {_CATALOGUE} where (tenant is null or tenant = 't1') and (clearance is null or clearance <= 2)")
def entitled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).filter(search.entitlement("t1", 2)).select("doc_id", "tenant", "clearance")


@query(f"""
with c as (select * from {_CATALOGUE}) select c.doc_id, c.source, l.quality, p.url is not null as has_page
from c left join labels l on l.doc_id = c.doc_id left join pages p on p.page_id = c.doc_id where c.doc_id % 3 = 0 and is_current""")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = catalogue(spark, sf_dir).filter((F.col("doc_id") % 3 == 0) & search.MetadataFilter(current=True).predicate())
    labels, pages = table(spark, sf_dir, "labels"), table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return wanted.join(labels, "doc_id", "left").join(pages, "doc_id", "left").select("doc_id", "source", "quality", F.col("url").isNotNull().alias("has_page"))


@query("select o_orderkey, o_totalprice, count(*) over () as total from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 20 offset 40")
def order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.listing(table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": None})
    return search.page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], size=20, number=2).select("o_orderkey", "o_totalprice", "total")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'red') or contains(lower(p_type), 'steel') or lower(p_brand) = 'brand#11'")
def part_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.lower("p_name").contains("red") | F.lower("p_type").contains("steel") | (F.lower("p_brand") == "brand#11")
    return table(spark, sf_dir, "part").filter(found).select("p_partkey", "p_name")


_ARMS = """
p as (select o_custkey, o_orderkey, 'dense' as arm, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank, 1.0 as bonus from orders),
t as (select o_custkey, o_orderkey, 'lexical' as arm, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rank, 1.0 as bonus from orders),
g as (select o_custkey, o_orderkey, 'graph' as arm, row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey) as rank, 1 + 0.1 * (o_totalprice / 1000000) as bonus from orders),
u as (select * from p where rank <= 10 union all select * from t where rank <= 10 union all select * from g where rank <= 10),
f as (select o_custkey, o_orderkey, round(sum(case arm when 'dense' then 1.0 when 'lexical' then 0.8 else 0.5 end::double * bonus / (60 + rank)), 9) as score,
  string_agg(arm || '=' || rank, ',' order by arm) as arm_ranks from u group by all)"""


def _arms(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    orders = orders.withColumn("edge", F.col("o_totalprice") / 1000000)
    by = {"dense": F.desc("o_totalprice"), "lexical": F.desc("o_orderdate"), "graph": F.asc("o_orderpriority")}
    arms = {arm: retrieval.ranked(orders, "o_custkey", [order, F.asc("o_orderkey")], 10).select("o_custkey", "o_orderkey", "rank", "edge") for arm, order in by.items()}
    return {arm: rows if arm == "graph" else rows.drop("edge") for arm, rows in arms.items()}


_WEIGHTS = {"dense": 1.0, "lexical": 0.8, "graph": 0.5}


@query(f"with {_ARMS} select o_custkey, o_orderkey, score, arm_ranks, rank from (select *, row_number() over (partition by o_custkey order by score desc, o_orderkey) as rank from f) where rank <= 5")
def tri_arm_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(search.tri_arm_fusion(_arms(spark, sf_dir), "o_custkey", "o_orderkey", weights=_WEIGHTS), "o_custkey", "o_orderkey", 5)


@query(f"""with {_ARMS},
b as (select o_custkey, o_orderkey, score, rank from (select *, row_number() over (partition by o_custkey order by score desc, o_orderkey) as rank from f) where rank <= 3),
l as (select o_custkey, o_orderkey, min(arm) as anchored_arm from u where rank = 1 group by all),
m as (select l.*, f.score, row_number() over (partition by l.o_custkey order by anchored_arm, l.o_orderkey) as n from l join f using (o_custkey, o_orderkey) anti join b on b.o_custkey = l.o_custkey and b.o_orderkey = l.o_orderkey),
c as (select o_custkey, count(*) as extra from m group by all),
k as (select b.* from b left join c using (o_custkey) where rank <= greatest(0, 3 - coalesce(extra, 0))),
h as (select o_custkey, count(*) as have from k group by all)
select o_custkey, o_orderkey, score, rank, null::varchar as anchored_arm from k
union all select m.o_custkey, o_orderkey, score, coalesce(have, 0) + n, anchored_arm from m left join h using (o_custkey) where coalesce(have, 0) + n <= 3""")
def arm_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = _arms(spark, sf_dir)
    fused = search.tri_arm_fusion(arms, "o_custkey", "o_orderkey", weights=_WEIGHTS)
    leaders = None
    for arm, rows in arms.items():
        first = rows.filter("rank = 1").select("o_custkey", "o_orderkey", F.lit(arm).alias("arm"))
        leaders = first if leaders is None else leaders.unionAll(first)
    return search.anchor_arm_leaders(fused, leaders, "o_custkey", "o_orderkey", 3)


@query("""
with c as (select l_partkey, count(*) as n from lineitem group by all), m as (select l_partkey, n / max(n) over () as c from c)
select l_partkey, round(c, 9) as centrality, round(p_retailprice * (1 + 0.2 * ln(1 + round(c, 9) * (exp(1) - 1))), 6) as boosted from m join part on p_partkey = l_partkey""")
def centrality_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    central = search.centrality(table(spark, sf_dir, "lineitem"), "l_partkey")
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    return central.join(parts, "l_partkey").select("l_partkey", "centrality", F.round(search.centrality_boost("p_retailprice", "centrality", 0.2), 6).alias("boosted"))


@query("""
select o_orderkey, round(o_totalprice * case left(o_orderpriority, 1)::integer when 1 then 1.25 when 2 then 1.15 when 3 then 1.05 when 5 then 0.85 else 1.0 end::double, 4) as boosted from orders""")
def authority_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(search.authority_boost("o_totalprice", tier), 4).alias("boosted"))


@query("""
with w as (select doc_id, list_filter(['the', 'der', 'que', 'les'], lambda w: contains(text, ' ' || w || ' ')) as m, lang from documents)
select doc_id, round(0.9 - case when len(m) > 0 and not list_contains(m, case lang when 'en' then 'the' when 'de' then 'der' when 'es' then 'que' else 'les' end) then 0.2 else 0 end, 6)::double as score from w""")
def conflicting_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.array_compact(F.array(*(F.when(F.col("text").contains(f" {w} "), F.lit(w)) for w in ("the", "der", "que", "les"))))
    own = F.array(F.when(F.col("lang") == "en", "the").when(F.col("lang") == "de", "der").when(F.col("lang") == "es", "que").otherwise("les"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(search.conflict_margin(F.lit(0.9), own, F.coalesce(named, F.array().cast("array<string>")), 0.2), 6).alias("score"))


@query("""
with k as (select lower(p_name) as key, max(p_size)::double as base from part group by 1), a as (select distinct left(p_name, 1 + (p_partkey % 4)::integer) as prefix from part where p_partkey % 20 = 0),
s as (select prefix, key, round(base * case when key = lower(trim(prefix)) then 1.3 else 0.8 + 0.2 * length(lower(trim(prefix))) / length(key) end, 6) as score from a join k on starts_with(key, lower(trim(prefix))) where trim(prefix) <> '')
select prefix, key, score, rank from (select *, row_number() over (partition by prefix order by score desc, key) as rank from s) where rank <= 5""")
def prefix_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    asked = parts.filter("p_partkey % 20 = 0").select(F.expr("left(p_name, 1 + p_partkey % 4)").alias("prefix"))
    return search.prefix_suggestions(parts.select(F.col("p_name").alias("key"), F.col("p_size").cast("double").alias("base")), asked, limit=5)
