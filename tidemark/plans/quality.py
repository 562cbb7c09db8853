"""Scanner, confidence and evaluation queries, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality, scans
from tidemark.plans.catalogue import query
from tidemark.sources.tables import table


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RULES = ", ".join(f"({_q(r.ident)}, {_q(r.kind)}, {_q(r.severity)}, {r.group})" for r in scans.RULES)
_PARTS = " union all ".join(
    f"select doc_id, {_q(r.ident)} as rule_id, regexp_extract_all(text, {_q(r.pattern)}) as hits, regexp_extract_all(text, {_q(r.pattern)}, {r.group}) as vals, list_transform(string_split_regex(text, {_q(r.pattern)}), lambda g: length(g)) as gaps from documents"
    for r in scans.RULES
)
_FINDINGS = f"""
p as ({_PARTS}), k as (select * from (values {_RULES}) t(rule_id, kind, severity, grp)),
e as (select doc_id, rule_id, hits, vals, gaps, unnest(range(1, len(hits) + 1)) as i from p where len(hits) > 0),
f as (select doc_id, rule_id, kind, severity, (list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) + instr(hits[i], vals[i]) - 1)::bigint as char_start, vals[i] as v from e join k using (rule_id))"""


@query(f"""with {_FINDINGS} select doc_id, rule_id, kind, severity, char_start, char_start + length(v) as char_end,
case when kind = 'secret' then case when length(v) <= 8 then '[redacted-secret]' else left(v, 4) || repeat('*', length(v) - 8) || right(v, 4) end
 when contains(v, '@') then left(v, 1) || '***@' || regexp_replace(v, '^[^@]*@', '') when length(v) >= 10 and regexp_matches(replace(replace(v, '-', ''), ' ', ''), '^[0-9]+$') then '***-***-' || right(replace(replace(v, '-', ''), ' ', ''), 4)
 when length(v) > 4 then left(v, 2) || '***' || right(v, 2) else '[redacted-pii]' end as sample from f""")
def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.findings(table(spark, sf_dir, "documents"))


@query(f"""with {_FINDINGS}, s as (select doc_id, count(*) as n from f where kind = 'secret' group by 1)
select d.doc_id, coalesce(n, 0) as n_secrets, case when coalesce(n, 0) > 0 then 'quarantined' else 'ok' end as status from documents d left join s on s.doc_id = d.doc_id""")
def scan_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scans.scan_policy(scans.findings(docs), docs, "quarantine")


_STOP = ", ".join(map(_q, scans.STOPWORDS))
_TERMS = lambda t: (
    f"list_transform(list_filter(regexp_extract_all(regexp_replace(lower({t}), '[^\\x00-\\x7F]', '_', 'g'), '\\b([a-z0-9\\-./]+)\\b', 1), lambda w: length(w) > 1 and w not in ({_STOP})), lambda w: "
    "case when ends_with(w, 'ing') and length(w) > 5 then left(w, length(w) - 3) when ends_with(w, 'ing') then w when ends_with(w, 'ed') and length(w) > 4 then left(w, length(w) - 2) "
    "when ends_with(w, 'tion') and length(w) > 6 then left(w, length(w) - 4) when ends_with(w, 's') and length(w) > 3 and not ends_with(w, 'ss') then left(w, length(w) - 1) else w end)"
)
_CONFIDENCE = f"""
q as (select conv_id, turn, any_value(text) as asked from conversations where role = 'user' group by all),
a as (select conv_id, turn - 1 as turn, list(text order by text) as passages from conversations where role = 'assistant' group by all),
t as (select conv_id, turn, list_distinct({_TERMS("asked")}) as qt, list_distinct(flatten(list_transform(passages[1:5], lambda p: {_TERMS("p")}))) as pt from q join a using (conv_id, turn)),
c as (select conv_id, turn, qt, list_sort(list_filter(qt, lambda w: not list_contains(pt, w))) as missing from t),
s as (select *, case when len(qt) = 0 then 0.0 else (len(qt) - len(missing))::double / len(qt) end as share from c)"""


@query(f"""with {_CONFIDENCE}
select conv_id, turn, round(share, 6) as coverage, case when len(qt) = 0 then 'LOW' when share >= 0.85 then 'HIGH' when share >= 0.65 then 'MEDIUM' else 'LOW' end as level, array_to_string(missing, ' ') as missing from s""")
def coverage_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _answers(spark, sf_dir)
    return found.select("conv_id", "turn", "c.coverage", "c.level", F.array_join("c.missing", " ").alias("missing"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").groupBy("conv_id", "turn").agg(F.any_value("text").alias("asked"))
    said = turns.filter("role = 'assistant'").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.sort_array(F.collect_list("text")).alias("passages"))
    return asked.join(said, ["conv_id", "turn"]).select("conv_id", "turn", scans.confidence(F.col("asked"), F.col("passages")).alias("c"))


@query(f"""with {_CONFIDENCE}, b as (select conv_id, turn, share, case when round(share, 6) < 0.5 then 'low' when round(share, 6) < 0.8 then 'medium' when round(share, 6) < 1.01 then 'high' end as band from s)
select band, count(*) as n, round(avg(round(share, 6)), 6) as coverage from b group by 1""")
def overlap_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir).select("c.coverage").withColumn("band", quality.band(F.col("coverage")))
    return quality.means(rows, ["coverage"], "band")


@query("""
select coalesce(quality::varchar, 'unknown') as quality, count(*) as n, round(coalesce(avg(toxic), 0), 6) as toxic, round(coalesce(avg(n_chars), 0), 6) as n_chars
from documents left join labels using (doc_id) group by 1""")
def slice_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.means(rows, ["toxic", "n_chars"], "quality")


@query("""
with r as (select doc_id % 10 = 0 as un, n_chars < 400 as ref, quality = 1 as ok from documents left join labels using (doc_id)),
n as (select count(*) filter (un and ref) as a, count(*) filter (not un and ref) as b, count(*) filter (not un) as c, count(*) filter (not un and not ref and coalesce(ok, false)) as d from r),
s as (select round(case when a + b > 0 then a / (a + b) else 1.0 end, 6)::double as refusal_precision, round(case when c - b > 0 then d / (c - b) else 1.0 end, 6)::double as selective_accuracy, round(case when c > 0 then b / c else 0.0 end, 6)::double as false_rejection from n)
select *, selective_accuracy >= 0.9 and refusal_precision >= 0.8 and false_rejection <= 0.1 as passed from s""")
def abstention_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.abstention(rows.select((F.col("doc_id") % 10 == 0).alias("unanswerable"), (F.col("n_chars") < 400).alias("refused"), (F.col("quality") == 1).alias("correct")))


_PAIRS = "p as (select least(1, n_chars / 4000.0)::double as confidence, quality::double as outcome from labels join documents using (doc_id))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select(F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("confidence"), F.col("quality").cast("double").alias("outcome"))


@query(f"""with {_PAIRS}, b as (select least(floor(confidence * 10), 9) as bin, count(*) as n, abs(avg(confidence) - avg(outcome)) as gap from p group by 1)
select coalesce(sum(n), 0)::bigint as n, round(sum(n * gap) / sum(n), 6) as ece, round(max(gap), 6) as mce from b""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.calibration_error(_pairs(spark, sf_dir), 10)


@query(f"""with recursive {_PAIRS}, b as (select least(floor(confidence * 10), 9)::bigint as bin, avg(outcome) as rate from p group by 1),
l as (select list(coalesce(rate, (x.i + 0.5) / 10) order by x.i) as r from (select unnest(range(0, 10)) as i) x left join b on b.bin = x.i),
w as (select 1 as i, r from l union all select i + 1, case when r[i + 1] < r[i] then list_concat(r[1:i - 1], [(r[i] + r[i + 1]) / 2, (r[i] + r[i + 1]) / 2], r[i + 2:]) else r end from w where i < 10)
select unnest(range(0, 10)) as bin, round(unnest(r), 9) as calibrated from w where i = 10""")
def fitted_calibrator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fit_calibrator(_pairs(spark, sf_dir), 10)


@query("""
with d as (select ts::date::varchar as day, round(count(*) filter (event_type = 'purchase') / count(*), 9)::double as rate from events group by 1),
w as (select day, rate, round(rate - avg(rate) over (order by day rows between 3 preceding and 1 preceding), 6) as delta from d)
select day, rate, delta, coalesce(delta < -0.01, false) as regressed from w""")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.count_if(F.col("event_type") == "purchase") / F.count("*"), 9).alias("rate"))
    return quality.regression_gate(days, "day", "rate")


@query(r"""
with w as (select d.item_id, list_filter(string_split_regex(lower(d.text), '\s+'), lambda x: x <> '') as a, list_filter(string_split_regex(lower(e.text), '\s+'), lambda x: x <> '') as b
  from benchmark d join benchmark e on e.item_id = d.item_id + 1),
k as (select item_id, a, list_transform(a, lambda x: [list_position(list_distinct(list_concat(a, b)), x)::bigint]) as ac, list_transform(b, lambda x: list_position(list_distinct(list_concat(a, b)), x)::bigint) as b from w),
t as (
  select item_id, a, b, list_reduce([range(0, len(b) + 1)] || ac, lambda prev, w:
    list_transform([list_transform(range(0, len(b) + 1), lambda n: if(n = 0, prev[1] + 1, least(prev[n + 1] + 1, prev[n] + if(b[n] = w[1], 0, 1))))],
      lambda r: list_transform(range(0, len(b) + 1), lambda n: list_min(list_transform(range(0, n + 1), lambda x: r[x + 1] + n - x))))[1]) as last from k)
select item_id, round(case when len(a) = 0 then if(len(b) = 0, 0.0, 1.0) else last[-1] / len(a) end, 6)::double as wer from t""")
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item of the benchmark against the next one, whole texts."""
    items = table(spark, sf_dir, "benchmark")
    other = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("heard"))
    return items.join(other, "item_id").select("item_id", F.round(scans.word_error_rate(F.col("text"), F.col("heard")), 6).alias("wer"))


@query("""
with s as (select l_orderkey, l_linenumber, l_partkey % 50 as a, l_partkey % 50 + l_quantity as b, l_suppkey % 50 as c, l_suppkey % 50 + l_quantity as d, l_discount as x from lineitem),
o as (select *, greatest(0, least(b, d) - greatest(a, c)) as shared from s)
select l_orderkey, l_linenumber, round(case when (b - a) + (d - c) - shared <= 0 then 0 else shared / ((b - a) + (d - c) - shared) end, 6)::double as span_iou,
  round(case when 1.0 * ((b - a) + (d - c)) - shared * 0.5 <= 0 then 0 else shared * 0.5 / (((b - a) + (d - c)) - shared * 0.5) end, 6)::double as box_iou from o""")
def overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans, and boxes of height 1 of which the second stands half below the first."""
    rows = table(spark, sf_dir, "lineitem")
    a, c = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    b, d = a + F.col("l_quantity"), c + F.col("l_quantity")
    box = scans.box_iou([a, F.lit(0.0), b, F.lit(1.0)], [c, F.lit(0.5), d, F.lit(1.5)])
    return rows.select("l_orderkey", "l_linenumber", F.round(scans.span_iou(a, b, c, d), 6).alias("span_iou"), F.round(box, 6).alias("box_iou"))


@query("""
with n as (select c_custkey, c_acctbal * 12345 as v, printf('%.2f', abs(c_acctbal * 12345)) as s from customer),
p as (select c_custkey, v, split_part(s, '.', 1) as i, split_part(s, '.', 2) as d from n),
g as (select *, case when length(i) <= 3 then i else reverse(regexp_replace(regexp_replace(reverse(left(i, length(i) - 3)), '([0-9]{2})', '\\1,', 'g'), ',$', '')) || ',' || right(i, 3) end as g from p)
select c_custkey, case when v < 0 then '-' else '' end || g || case when d = '00' then '' else '.' || d end as formatted from g""")
def indian_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", scans.indian_number(F.col("c_acctbal") * 12345).alias("formatted"))
