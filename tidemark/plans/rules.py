"""Registered queries over deadlines, intervals, mentions and declared identities, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.plans.catalogue import query
from tidemark.sources.tables import table

#: The moment from which deadlines are looked at; no query reads the clock.
NOW = "2024-01-30 12:00:00"
TODAY = "1997-06-01"


@query(f"""
select event_id, ts + interval 6 hour as deadline,
  greatest(0, floor(epoch(ts + interval 6 hour - timestamp '{NOW}') / 60))::bigint as minutes_left,
  ts + interval 6 hour - timestamp '{NOW}' < interval 1 hour as urgent
from events where event_type = 'error'""")
def incident_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When an incident has to be reported, and how long that is from now."""
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("deadline", F.expr("ts + interval 6 hours"))
    left = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{NOW}', deadline)") / 60e6
    return errors.select("event_id", "deadline", F.greatest(F.lit(0), F.floor(left)).cast("long").alias("minutes_left"), (left < 60).alias("urgent"))


@query(f"""
select o_orderpriority,
  count(*) filter (days <= 15) as critical, count(*) filter (days > 15 and days <= 45) as upcoming, count(*) filter (days > 45) as later,
  min(o_orderdate) as first_deadline
from (select *, date_diff('day', date '{TODAY}', o_orderdate::date) as days from orders where o_orderdate::date >= date '{TODAY}')
group by o_orderpriority""")
def deadline_urgency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coming deadlines by priority and urgency."""
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit(TODAY).cast("date"))
    due = table(spark, sf_dir, "orders").withColumn("days", days).filter("days >= 0")
    return due.groupBy("o_orderpriority").agg(
        F.count_if(F.col("days") <= 15).alias("critical"),
        F.count_if(F.col("days").between(16, 45)).alias("upcoming"),
        F.count_if(F.col("days") > 45).alias("later"),
        F.min("o_orderdate").alias("first_deadline"),
    )


@query("""
with spans as (select user_id, event_id, epoch_us(ts) as low, epoch_us(ts) + cast(floor(value * 60e6) as bigint) as high from events where value >= 0),
reached as (select *, max(high) over (partition by user_id order by low, event_id rows between unbounded preceding and 1 preceding) as before from spans),
runs as (select *, sum(case when before is null or low > before then 1 else 0 end) over (partition by user_id order by low, event_id rows unbounded preceding) as run from reached)
select user_id, cast(run as bigint) as run, count(*) as events, max(high) - min(low) as micros from runs group by all""")
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping or touching spans of a user (an event and ``value`` minutes) as one run."""
    low = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    spans = table(spark, sf_dir, "events").filter("value >= 0").select("user_id", "event_id", low.alias("low"), (low + F.floor(F.col("value") * 60e6)).alias("high"))
    order = W.Window.partitionBy("user_id").orderBy("low", "event_id")
    before = F.max("high").over(order.rowsBetween(W.Window.unboundedPreceding, -1))
    starts = spans.withColumn("before", before).withColumn("starts", F.coalesce(F.col("low") > F.col("before"), F.lit(True)).cast("long"))
    runs = starts.withColumn("run", F.sum("starts").over(order.rowsBetween(W.Window.unboundedPreceding, 0)))
    return runs.groupBy("user_id", "run").agg(F.count("*").alias("events"), (F.max("high") - F.min("low")).alias("micros"))


_NUMBER = r"[0-9]+(?:[.,][0-9]+)*"


@query(f"""
select doc_id, len(found) as mentions, len(list_distinct(found)) as different, list_max(list_transform(found, lambda x: length(x))) as longest
from (select doc_id, regexp_extract_all(text, '{_NUMBER}') as found from documents where text is not null) where len(found) > 0""")
def number_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that a text names."""
    found = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.regexp_extract_all("text", F.lit(_NUMBER), F.lit(0)).alias("found"))
    return found.filter(F.size("found") > 0).select(
        "doc_id",
        F.size("found").cast("long").alias("mentions"),
        F.size(F.array_distinct("found")).cast("long").alias("different"),
        F.array_max(F.transform("found", F.length)).cast("long").alias("longest"),
    )


_DATE = r"\b[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}\b|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"


@query(f"""
with t as (select doc_id, text || ' In force from ' || strftime(date '2023-11-05' + (doc_id % 900)::integer, '%d.%m.%Y') || ', reviewed on ' || strftime(date '2023-12-01' + (doc_id % 700)::integer, '%Y-%m-%d') || ' and not on 31/02/2024 or 01-01-1999.' as text from documents where text is not null),
found as (select doc_id, unnest(regexp_extract_all(text, '{_DATE}')) as said from t),
dated as (select doc_id, case when said[5:5] = '-' then try_strptime(said, '%Y-%m-%d') else try_strptime(regexp_replace(said, '[./]', '-', 'g'), '%d-%m-%Y') end::date as day from found)
select distinct doc_id, day from dated where day between date '2000-01-01' and date '2099-12-31'""")
def date_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that a text names, day before month, each once; the documents get a last sentence with dates."""
    day = lambda first, n, form: F.date_format(F.date_add(F.lit(first).cast("date"), (F.col("doc_id") % n).cast("int")), form)
    dated = F.concat("text", F.lit(" In force from "), day("2023-11-05", 900, "dd.MM.yyyy"), F.lit(", reviewed on "), day("2023-12-01", 700, "yyyy-MM-dd"), F.lit(" and not on 31/02/2024 or 01-01-1999."))
    found = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", dated.alias("text")).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_DATE), F.lit(0))).alias("said"))
    parts = F.split("said", "[./-]").cast("array<int>")
    iso = F.substring("said", 5, 1) == "-"
    text = F.when(iso, F.format_string("%04d-%02d-%02d", parts[0], parts[1], parts[2])).otherwise(F.format_string("%04d-%02d-%02d", parts[2], parts[1], parts[0]))
    day = F.expr("try_cast(said as date)")
    return found.withColumn("said", text).select("doc_id", day.alias("day")).filter("day between date'2000-01-01' and date'2099-12-31'").distinct()


@query("""
with sums as (select l_orderkey, sum(l_extendedprice) as gross, sum(l_extendedprice * (1 - l_discount)) as net, sum(l_extendedprice * l_discount) as discount from lineitem group by 1)
select o_orderkey, 'net_and_discount' as identity, abs(net + discount - gross) <= 0.01 as holds from orders join sums on o_orderkey = l_orderkey
union all
select o_orderkey, 'declared_total', abs(o_totalprice - gross) <= 0.01 * gross from orders join sums on o_orderkey = l_orderkey""")
def declared_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounting identities of an order against its lines."""
    price = F.col("l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(price).alias("gross"), F.sum(price * (1 - F.col("l_discount"))).alias("net"), F.sum(price * F.col("l_discount")).alias("discount")
    )
    whole = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    tests = {
        "net_and_discount": F.abs(F.col("net") + F.col("discount") - F.col("gross")) <= 0.01,
        "declared_total": F.abs(F.col("o_totalprice") - F.col("gross")) <= 0.01 * F.col("gross"),
    }
    pairs = [F.struct(F.lit(k).alias("identity"), v.alias("holds")) for k, v in tests.items()]
    return whole.select("o_orderkey", F.inline(F.array(*pairs)))


#: Fixed example of a crosswalk: (framework, control, framework, control, relation).
_KNOWN = """select p_brand as source, p_type as control, s_name as target, l_returnflag as other, case max(l_linenumber) % 4 when 0 then 'EXACT' when 1 then 'SUBSET' when 2 then 'SUPERSET' else 'RELATED' end as relation
  from {lineitem} join {part} on p_partkey = l_partkey join {supplier} on s_suppkey = l_suppkey group by 1, 2, 3, 4"""
_FLIP = "case relation when 'SUBSET' then 'SUPERSET' when 'SUPERSET' then 'SUBSET' else 'EXACT' end"


@query(f"""
with known as ({_KNOWN.format(lineitem="lineitem", part="part", supplier="supplier")})
select source, control, target, other, relation, false as inverse from known
union all select target, other, source, control, {_FLIP}, true from known""")
def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crosswalk of brands' types and suppliers' flags, read in both directions; a subset's inverse is a superset."""
    known = spark.sql(_KNOWN, **{name: table(spark, sf_dir, name) for name in ("lineitem", "part", "supplier")})
    back = known.select(F.col("target"), F.col("other"), F.col("source"), F.col("control"), F.expr(_FLIP), F.lit(True))
    return known.withColumn("inverse", F.lit(False)).union(back)


@query("""
select o.o_orderkey, o.o_custkey, count(x.o_orderkey) as earlier, coalesce(sum(x.o_totalprice), 0) as earlier_total
from orders o left join orders x on x.o_custkey = o.o_custkey and x.o_orderdate < o.o_orderdate and x.o_orderdate >= o.o_orderdate - interval 365 day
group by 1, 2""")
def trailing_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its customer's orders of the 365 days before its day: a range frame, no self-join."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    frame = W.Window.partitionBy("o_custkey").orderBy("day").rangeBetween(-365, -1)
    orders = table(spark, sf_dir, "orders").withColumn("day", day)
    return orders.select("o_orderkey", "o_custkey", F.count("*").over(frame).alias("earlier"), F.coalesce(F.sum("o_totalprice").over(frame), F.lit(0.0)).alias("earlier_total"))


@query("""
with said as (select conv_id, turn, role, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x))) as words from conversations where text is not null),
pairs as (select *, lag(words) over (partition by conv_id order by turn, role) as before from said)
select conv_id, turn, len(words) as words, len(list_intersect(words, before)) as supported, round(len(list_intersect(words, before)) / len(words)::double, 6) as share
from pairs where role = 'assistant' and before is not null and len(words) > 0""")
def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a reply's words the turn before it holds."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower))
    said = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", "role", words.alias("words"))
    pairs = said.withColumn("before", F.lag("words").over(W.Window.partitionBy("conv_id").orderBy("turn", "role")))
    replies = pairs.filter("role = 'assistant' and before is not null and size(words) > 0")
    n, held = F.size("words").cast("long"), F.size(F.array_intersect("words", "before")).cast("long")
    return replies.select("conv_id", "turn", n.alias("words"), held.alias("supported"), F.round(held / n, 6).alias("share"))


@query("""
with told as (select lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as word from documents where text is not null),
vocabulary as (select word, count(*) as n from told where length(word) >= 4 group by 1 having count(*) >= 2),
asked as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as word from benchmark where text is not null),
unknown as (select word from asked where length(word) >= 4 and word not in (select word from vocabulary)),
a as (select word, unnest(list_distinct(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))))) as part from unknown),
b as (select word, n, unnest(list_distinct(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))))) as part from vocabulary),
near as (select distinct a.word, b.word as suggestion, b.n from a join b using (part) where levenshtein(a.word, b.word) = 1)
select word, suggestion, n from (select *, row_number() over (partition by word order by n desc, suggestion) as place from near) where place <= 3""")
def word_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known words at distance one of each unknown one, by an equal word after at most one deletion."""

    def words(name: str) -> DataFrame:
        found = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
        return table(spark, sf_dir, name).filter("text is not null").select(found.alias("word")).select(F.lower("word").alias("word")).filter("length(word) >= 4")

    def parts(rows: DataFrame) -> DataFrame:
        cut = F.expr("transform(sequence(1, length(word)), i -> concat(substr(word, 1, i - 1), substr(word, i + 1)))")
        return rows.withColumn("part", F.explode(F.array_distinct(F.concat(F.array("word"), cut))))

    vocabulary = words("documents").groupBy("word").agg(F.count("*").alias("n")).filter("n >= 2")
    unknown = words("benchmark").distinct().join(vocabulary, "word", "left_anti")
    known = parts(vocabulary).withColumnRenamed("word", "suggestion")
    near = parts(unknown).join(known, "part").filter(F.levenshtein("word", "suggestion") == 1).select("word", "suggestion", "n").distinct()
    place = F.row_number().over(W.Window.partitionBy("word").orderBy(F.desc("n"), "suggestion"))
    return near.withColumn("place", place).filter("place <= 3").drop("place")


#: Fixed example of rules: (rule, least quantity, quantity below, first day, last day).
RULES = [("small", 0, 10, "1992-01-01", "1995-12-31"), ("middle", 10, 30, "1994-01-01", "1999-12-31"), ("large", 30, 1000, "1992-01-01", "1996-12-31")]


@query(f"""
with rules(rule, low, high, first, last) as (values {", ".join(map(str, RULES))})
select rule, count(*) as lines, round(sum(l_quantity), 2) as quantity
from lineitem left join rules on l_quantity >= low and l_quantity < high and l_shipdate::date between first::date and last::date group by rule""")
def rule_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the rule whose quantities and days hold them; the rules are a list of fixed length, so they are broadcast."""
    rules = F.broadcast(spark.createDataFrame(RULES, "rule string, low int, high int, first string, last string"))
    day = F.col("l_shipdate").cast("date")
    holds = (F.col("l_quantity") >= F.col("low")) & (F.col("l_quantity") < F.col("high")) & day.between(F.col("first").cast("date"), F.col("last").cast("date"))
    return table(spark, sf_dir, "lineitem").join(rules, holds, "left").groupBy("rule").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
