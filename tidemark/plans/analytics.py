"""Registered queries over texts, rankings, graphs and event streams, each with its SQL twin."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.operators import graph, measures, registry, retrieval, texts
from tidemark.plans.catalogue import query
from tidemark.sources.tables import table
from tidemark.streaming import windows


@query("""
select sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as sha, count(*) as copies, min(doc_id) as first_doc
from documents where text is not null group by 1""")
def text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.groupBy(texts.fingerprint("text").alias("sha")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query("""
select doc_id, length(regexp_replace(text, '\\s', '', 'g')) as clean_chars,
  greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 4 // 3, 1) as tokens,
  len(list_filter(string_split_regex(text, '[.!?]\\s+'), lambda s: s <> '')) as sentences,
  round(len(regexp_extract_all(text, '[à-ÿÀ-ß]')) / greatest(len(regexp_extract_all(text, '[a-zA-Zà-ÿÀ-ß]')), 1)::double, 6) as accented
from documents where text is not null""")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    accented, letters = F.regexp_count("text", F.lit("[à-ÿÀ-ß]")), F.regexp_count("text", F.lit("[a-zA-Zà-ÿÀ-ß]"))
    return table(spark, sf_dir, "documents").filter("text is not null").select(
        "doc_id",
        F.length(F.regexp_replace("text", r"\s", "")).cast("long").alias("clean_chars"),
        texts.approximate_tokens("text").alias("tokens"),
        F.size(texts.sentences("text")).cast("long").alias("sentences"),
        F.round(accented / F.greatest(letters, F.lit(1)), 6).alias("accented"),
    )


@query("""
select doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g'),
  '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}', '[IP]', 'g')) as masked_md5 from documents""")
def masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(texts.masked("text")).alias("masked_md5"))


@query("""
with t as (select page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as body from pages)
select page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '^\\s+|\\s+$', '', 'g'), '[\\s-]+', '-', 'g') as slug, length(body) as n_chars, md5(body) as md5 from t""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("body", texts.main_text("html"))
    return pages.select("page_id", texts.slug("url").alias("slug"), F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("md5"))


@query("""select distinct page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as link from pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.links(table(spark, sf_dir, "pages").dropDuplicates(["page_id", "html"])).distinct()


@query("""
with n as (select conv_id, turn, role, text, nullif(regexp_extract(text, '(?:^| )([A-Z][a-z]{3,})', 1), '') as name from conversations)
select conv_id, turn, role, name, last_value(name ignore nulls) over (partition by conv_id order by turn, role, text rows between unbounded preceding and 1 preceding) as antecedent from n""")
def last_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.last_entity(table(spark, sf_dir, "conversations"))


@query("""
with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders),
g as (select o_custkey, o_orderkey, o_orderpriority as grp from orders where o_orderstatus = 'O'),
f as (select o_custkey, grp, min(rank) as first from g join r using (o_custkey, o_orderkey) where rank <= 20 group by all),
s as (select o_custkey, count(*) filter (first <= 5) as covered, sum(case when first <= 5 then 1 / log2(first + 1) else 0.0 end) as dcg, min(first) as best from f group by 1),
a as (select o_custkey, count(distinct grp) as n from g group by 1)
select o_custkey, round(coalesce(covered, 0) / n::double, 6) as recall, coalesce(covered, 0) > 0 as hit, round(coalesce(1.0::double / best, 0), 6) as reciprocal_rank,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg from a left join s using (o_custkey)""")
def ranking_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    ranked = retrieval.ranked(orders, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 20)
    groups = orders.filter("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("group"))
    return measures.group_scores(ranked, groups, "o_custkey", "o_orderkey", k=5)


@query("""
with r as (select least(n_chars / 5000.0::double, 1) as score, quality = 1 as good from labels join documents using (doc_id)),
t as (select unnest([0.1, 0.25, 0.5, 0.75, 0.9])::double as threshold)
select threshold, count(*) filter (score < threshold) as refused,
  round(count(*) filter (score < threshold and not good) / (count(*) filter (not good))::double, 6) as refusal_recall,
  round(count(*) filter (score < threshold and good) / (count(*) filter (good))::double, 6) as false_rejection from r, t group by 1""")
def refusal_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    scored = rows.select(F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("score"), (F.col("quality") == 1).alias("answerable"))
    return measures.threshold_sweep(scored, [0.1, 0.25, 0.5, 0.75, 0.9])


@query("""
with c as (select count(*) filter (quality = 1 and toxic = 1) as only_a, count(*) filter (quality = 0 and toxic = 0) as only_b from labels)
select only_a, only_b, round((abs(only_a - only_b) - 1) * (abs(only_a - only_b) - 1) / (only_a + only_b)::double, 6) as statistic from c""")
def discordant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
    return measures.mcnemar(rows, "a", "b")


@query("""
with u as (select user_id, arg_min(event_type, event_id) as a, arg_max(event_type, event_id) as b from events group by 1),
t as (select count(*) as n, count(*) filter (a = b) as same from u),
p as (select sum(x * y)::double as xy from (select a as k, count(*) as x from u group by 1) join (select b as k, count(*) as y from u group by 1) using (k))
select n, round(same / n::double, 6) as observed, round(xy / (n * n), 6) as expected, round((same / n::double - xy / (n * n)) / (1 - xy / (n * n)), 6) as kappa from t, p""")
def multiclass_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("a"), F.max_by("event_type", "event_id").alias("b"))
    return measures.multiclass_kappa(users, "a", "b")


@query("""
with d as (select doc_id, (quality - toxic)::double as d from labels),
u as (select turn, d, ('0x' || substr(md5(turn::varchar || '|' || doc_id::varchar), 1, 8))::ubigint::double / 4294967296.0 as u from d, range(100) t(turn)),
w as (select turn, d, (u >= 0.36787944117144233::double)::int + (u >= 0.7357588823428847::double)::int + (u >= 0.9196986029286058::double)::int + (u >= 0.9810118431238462::double)::int
  + (u >= 0.9963401531726563::double)::int + (u >= 0.9994058151824183::double)::int + (u >= 0.9999167588507119::double)::int + (u >= 0.9999897508033253::double)::int as w from u),
m as (select list_sort(list(round(mean, 9))) as means from (select sum(w * d) / sum(w) as mean from w group by turn))
select (select count(*) from d) as n, (select round(avg(d), 6) from d) as mean, round(means[3], 6) as low, round(means[98], 6) as high from m""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).alias("delta"))
    return measures.paired_bootstrap(rows, "doc_id", "delta")


@query("""
with e as (select 's' || s_suppkey as src, 'n' || s_nationkey as dst, 0.9::double as w from supplier union all select 'n' || n_nationkey, 'r' || n_regionkey, 0.7::double from nation),
a as (select dst, max(w) * 0.85 as score from e where src in (select 's' || s_suppkey from supplier where s_acctbal > 5000) group by 1),
b as (select e.dst, max(w) * 0.85 * 0.85 as score from e join a on e.src = a.dst group by 1)
select dst as node, round(max(score), 6) as score from (select * from a union all select * from b) group by 1""")
def graph_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    edges = suppliers.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"), F.lit("located").alias("relation")).unionAll(
        nations.select(name("n", "n_nationkey"), name("r", "n_regionkey"), F.lit("part"))
    )
    seeds = suppliers.filter("s_acctbal > 5000").select(name("s", "s_suppkey").alias("node"))
    return graph.k_hop(seeds, edges, {"located": 0.9}).select("node", F.round("score", 6).alias("score"))


@query("""
with recursive e as (select distinct c_nationkey as src, s_nationkey as dst from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey),
n as (select src as node from e union select dst from e), c as (select count(*) as cn from n), o as (select src, count(*) as deg from e group by 1),
pr as (select node, 0 as i, 1.0::double / cn as r from n, c union all
  select n.node, p.i + 1, 0.15 / any_value(c.cn) + 0.85 * sum(case when o.deg is null then p.r / c.cn when e.dst is not null then p.r / o.deg else 0.0 end)
  from pr p cross join n cross join c left join o on o.src = p.node left join e on e.src = p.node and e.dst = n.node where p.i < 20 group by n.node, p.i)
select node, round(r, 6) as rank from pr where i = 20""")
def trade_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    edges = lines.join(orders, "l_orderkey").join(customers, "c_custkey").join(suppliers, "l_suppkey").select("src", "dst")
    return graph.pagerank(edges).select("node", F.round("rank", 6).alias("rank"))


@query("""
select o_orderkey as node, last_value(o_orderkey) over w as last, count(*) over w - row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as steps
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following)""")
def successor_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = F.lead("o_orderkey").over(W.Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return graph.chain_ends(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), following.alias("next")))


@query("""
select date_trunc('hour', ts) as start, count(*) as total, count(*) filter (event_type = 'error') as errors from events group by 1""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(table(spark, sf_dir, "events"))


@query("""
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 1 hour then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, s""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(table(spark, sf_dir, "events"))


@query("""
select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1""")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("row")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(newest).select("user_id", "event_type", "row.event_id", "row.value")


@query("""
select event_id, user_id, errors, seen >= 5 and errors >= 0.3 * seen as alert from (select event_id, user_id,
  count(*) filter (event_type = 'error') over w as errors, count(*) over w as seen from events window w as (partition by user_id order by ts, event_id rows 19 preceding))""")
def error_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = W.Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-19, 0)
    seen = table(spark, sf_dir, "events").select("event_id", "user_id", F.count_if(F.col("event_type") == "error").over(last).alias("errors"), F.count("*").over(last).alias("seen"))
    return seen.select("event_id", "user_id", "errors", ((F.col("seen") >= 5) & (F.col("errors") >= 0.3 * F.col("seen"))).alias("alert"))


@query("select distinct o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0) or o_orderkey in (select l_orderkey from lineitem where l_discount >= 0.1)")
def either_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join by either of two keys, as a union of two semi-joins."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    poor = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    cheap = table(spark, sf_dir, "lineitem").filter("l_discount >= 0.1").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(poor, "o_custkey", "left_semi").select("o_orderkey").union(orders.join(cheap, "o_orderkey", "left_semi").select("o_orderkey")).distinct()


@query("""
select k, count(*) as n from (select 'both' as k, * from (select c_nationkey from customer intersect select s_nationkey from supplier)
  union all select 'customer only', * from (select c_nationkey from customer except select s_nationkey from supplier)
  union all select 'either', * from (select c_nationkey from customer union select s_nationkey from supplier)) group by 1""")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    named = [("both", a.intersect(b)), ("customer only", a.subtract(b)), ("either", a.union(b).distinct())]
    parts = [rows.select(F.lit(name).alias("k")) for name, rows in named]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("k").agg(F.count("*").alias("n"))


@query("""
select c_custkey, case when c_acctbal < 500 then 'BREACH' when c_acctbal < 525 then 'WARNING' else 'COMPLIANT' end as status, round(c_acctbal - 500, 2) as margin from customer""")
def boundary_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lower bound of 500, with a warning within 5 % above it."""
    value = F.col("c_acctbal")
    status = F.when(value < 500, "BREACH").when(value < 525, "WARNING").otherwise("COMPLIANT")
    return table(spark, sf_dir, "customer").select("c_custkey", status.alias("status"), F.round(value - 500, 2).alias("margin"))


@query("""
with s as (select unnest(range(-10, 11, 5)) as shift), b as (select sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as base from lineitem),
r as (select shift, sum(l_extendedprice * (1 - l_discount * (1 + shift / 100.0::double)) * (1 + l_tax)) as revenue from lineitem, s group by 1)
select shift, round(revenue, 2) as revenue, round(100 * (revenue - base) / base, 6) as change_pct from r, b""")
def discount_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue if all discounts were some per cent higher or lower; one pass, five sums."""
    revenue = lambda shift: F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount") * (1 + F.lit(shift) / 100.0)) * (1 + F.col("l_tax")))
    sums = table(spark, sf_dir, "lineitem").agg(revenue(0).alias("base"), *(revenue(s).alias(f"r{s}") for s in range(-10, 11, 5)))
    each = F.explode(F.array(*(F.struct(F.lit(s).cast("long").alias("shift"), F.col(f"r{s}").alias("revenue")) for s in range(-10, 11, 5)))).alias("x")
    return sums.select("base", each).select("x.shift", F.round("x.revenue", 2).alias("revenue"), F.round(100 * (F.col("x.revenue") - F.col("base")) / F.col("base"), 6).alias("change_pct"))


@query("""
with t as (select l_suppkey, count(*) filter (l_returnflag = 'R') as returned, count(*) filter (l_discount >= 0.1) as cheap, count(*) as n from lineitem group by 1),
s as (select l_suppkey, greatest(100 - 15 * returned / n::double * 2 - 8 * cheap / n::double * 5, 0) as score from t)
select l_suppkey, round(score, 4) as score, case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 70 then 'C' when score >= 60 then 'D' else 'F' end as grade from s""")
def supplier_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") >= 0.1).alias("cheap"), F.count("*").alias("n")
    )
    scored = counted.withColumn("score", F.greatest(100 - 15 * F.col("returned") / F.col("n") * 2 - 8 * F.col("cheap") / F.col("n") * 5, F.lit(0.0)))
    grade = F.lit("F")
    for least, letter in ((60, "D"), (70, "C"), (80, "B"), (90, "A")):
        grade = F.when(F.col("score") >= least, letter).otherwise(grade)
    return scored.select("l_suppkey", F.round("score", 4).alias("score"), grade.alias("grade"))


@query("""
select l_orderkey, l_linenumber, lag(l_partkey) over w as before, lead(l_partkey) over w as after from lineitem
window w as (partition by l_orderkey order by l_linenumber, l_partkey)""")
def sibling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of each line in its order."""
    near = W.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lag("l_partkey").over(near).alias("before"), F.lead("l_partkey").over(near).alias("after"))


#: A formula needs those of half and of a third of its key.
_WALK = """
with recursive need(node, input) as (select p_partkey as node, p_partkey // 2 as input from part where p_partkey > 0 and p_partkey % 2 = 0 union all select p_partkey, p_partkey // 3 from part where p_partkey > 0 and p_partkey % 3 = 0),
walk(node, input, tier) as (select node, input, 1 from need union all select w.node, n.input, w.tier + 1 from walk w join need n on w.input = n.node)
select node, cast(max(tier) as bigint) as tier, count(distinct input) as prerequisites from walk group by node"""


@query(_WALK)
def formula_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest way to an input and number of prerequisites of each formula, of which there is one a part."""
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").filter(key > 0)
    needs = (parts.filter(key % n == 0).select(key.alias("node"), F.expr(f"p_partkey div {n}").alias("input")) for n in (2, 3))
    return registry.prerequisites(functools.reduce(DataFrame.unionAll, needs))
