"""Registered queries of cleaning that keeps places, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cleaning
from tidemark.plans.catalogue import query
from tidemark.sources.tables import table


@query(r"""
with t as (select doc_id, text, regexp_replace(text, '[0-9]', '', 'g') as a, regexp_replace(regexp_replace(text, '[0-9]', '', 'g'), '[.,;:!?]', '', 'g') as clean from documents where text is not null),
w as (select doc_id, text, clean, regexp_extract_all(clean, '\S+') as w, string_split_regex(clean, '\S+') as g from t),
s as (
  select doc_id, text, clean, i, sum(len(g[i]) + len(w[i])) over (partition by doc_id order by i) - len(w[i]) as s, sum(len(g[i]) + len(w[i])) over (partition by doc_id order by i) as e
  from (select *, unnest(range(1, len(w) + 1)) as i from w) where i <= 40),
k as (select doc_id, list(p order by p) as kept from (select doc_id, p from (select doc_id, text, unnest(range(1, length(text) + 1)) as p from t) where not regexp_matches(text[p], '[0-9.,;:!?]')) group by doc_id)
select doc_id, s::int as start, e::int as "end", (kept[(s + 1)::bigint] - 1)::int as raw_start, kept[e::bigint]::int as raw_end from s join k using (doc_id)""")
def spans_through_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits and then stops are cut out of the documents; the first forty words of what is left are found in the original."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    once = cleaning.cut_out(docs, "[0-9]").withColumnRenamed("runs", "first")
    twice = cleaning.cut_out(once, "[.,;:!?]")
    maps = cleaning.compose(twice, "runs", "first", "whole").select("doc_id", F.col("whole").alias("runs"))
    words, gaps = F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, 40), F.split("text", r"\S+", -1)
    size = lambda k: F.length(F.col("w")[k]) + F.length(F.col("g")[k])
    ends = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.aggregate(F.sequence(F.lit(0), i - 1), F.lit(0), lambda s, k: s + size(k)))
    found = twice.select("doc_id", words.alias("w"), gaps.alias("g")).filter("size(w) > 0").withColumn("ends", ends)
    spans = found.select("doc_id", F.explode(F.arrays_zip("w", "ends")).alias("x")).select("doc_id", (F.col("x.ends") - F.length("x.w")).alias("start"), F.col("x.ends").alias("end"))
    return cleaning.mapped_back(spans, maps, "doc_id")


@query(r"""
select page_id, length(html) + length(page_id::varchar) + 37 as n, length(page_id::varchar) + 27 as changed, 'page_numbers,watermarks' as kinds, 22 as furniture_chars from pages""")
def blanked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furniture at the end of each page becomes spaces; nothing changes its place, and nothing else changes."""
    text = F.concat("html", F.format_string(" Page %d of 99 \n7\nFor Official Use Only", "page_id"))
    found = cleaning.blank_noise(table(spark, sf_dir, "pages").select("page_id", text.alias("text"), text.alias("raw")))
    bare = lambda c: F.length(F.regexp_replace(c, r"\s", ""))
    return found.select("page_id", F.length("text").alias("n"), (bare("raw") - bare("text")).alias("changed"), F.array_join("furniture_kinds", ",").alias("kinds"), "furniture_chars")


@query(r"""
with t as (select doc_id, source, 'Bulletin of ' || source || chr(10) || text || chr(10) || case when doc_id % 4 > 0 then 'Page ' || doc_id || ' / 20' else 'end' end as text from documents where text is not null),
l as (select doc_id, source, string_split(text, chr(10)) as l from t),
e as (
  select source, i - 1 as place, l[i] as line from (select *, unnest(range(1, least(len(l), 3) + 1)) as i from l)
  union all select source, -i, l[len(l) + 1 - i] from (select *, unnest(range(1, least(len(l), 3) + 1)) as i from l)),
n as (select source, place, regexp_replace(trim(line, ' '), '[0-9]+', '#', 'g') as line, count(*) as n from e where trim(line, ' ') <> '' group by all having count(*) >= 3),
c as (select source, count(*) as texts from t group by source)
select n.source, place::int as place, line, n, texts from n join c on c.source is not distinct from n.source where n >= 0.5 * texts""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents between a heading and, mostly, a page number: both repeat, the texts between them don't."""
    text = F.concat(F.lit("Bulletin of "), "source", F.lit("\n"), "text", F.lit("\n"), F.when(F.col("doc_id") % 4 > 0, F.format_string("Page %d / 20", "doc_id")).otherwise("end"))
    return cleaning.repeated_lines(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", text.alias("text")), "source")
