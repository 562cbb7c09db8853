"""Registered queries of highlights and of tables in texts, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import layouts, pinpoint, retrieval
from tidemark.plans.catalogue import ORACLE_SQL, query
from tidemark.plans.quality import _STOP
from tidemark.sources.tables import table


def _terms(t: str) -> str:
    stem = "case when w like '%ing' and length(w) > 5 then left(w, -3) when w like '%ing' then w when w like '%ed' and length(w) > 4 then left(w, -2) when w like '%tion' and length(w) > 6 then left(w, -4) when w like '%s' and length(w) > 3 and w not like '%ss' then left(w, -1) else w end"
    found = f"regexp_extract_all(regexp_replace(lower({t}), '[^\\x00-\\x7F]', '_', 'g'), '\\b([a-z0-9\\-./]+)\\b', 1)"
    return f"list_transform(list_filter({found}, lambda w: length(w) > 1 and w not in ({_STOP})), lambda w: {stem})"


_PAIRS = """
pairs as (select item_id, doc_id from ({found})),
posts as (select doc_id, unnest(t) as term, unnest(range(len(t))) as place from (select doc_id, {d} as t from documents where doc_id in (select doc_id from pairs))),
asked as (select distinct item_id, unnest({q}) as term from benchmark),
met as (select item_id, doc_id, term, place from pairs join asked using (item_id) join posts using (doc_id, term))""".format(d=_terms("text"), q=_terms("text"), found=ORACLE_SQL["bm25_search"])


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents that BM25 finds for each item."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.bm25(items, docs, k=10).select("item_id", "doc_id"), items, docs


@query(f"""
with {_PAIRS},
k as (select item_id, doc_id, count(distinct term) as n from met group by all),
ends as (select m.item_id, m.doc_id, m.place as last, t.term, max(t.place) as earliest from met m join met t on t.item_id = m.item_id and t.doc_id = m.doc_id and t.place <= m.place group by all),
runs as (select item_id, doc_id, last, min(earliest) as first, count(*) as n from ends group by all),
best as (select *, row_number() over (partition by item_id, doc_id order by last - first, first) as r from runs join k using (item_id, doc_id, n))
select item_id, doc_id, n::int as n_terms, first::int as first, last::int as last from best where r = 1""")
def cover_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least run of a document's terms that holds all terms it shares with an item."""
    return pinpoint.cover_windows(*_pairs(spark, sf_dir))


@query()
def pinpointed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sentences of the documents that BM25 finds for each item (tests hold them against a plain version)."""
    return pinpoint.pinpoint(*_pairs(spark, sf_dir), least=0.3)


@query("""
with o as (select o_custkey, o_orderkey, o_orderstatus, o_orderpriority, row_number() over (partition by o_custkey order by o_orderkey) - 1 as r from orders)
select o_custkey, 0 as ordinal, 2 as first_line, 'Order -> key|Order -> status|Priority' as headers, r::int as line, o_orderkey || '|' || case when o_orderkey % 3 = 0 then '' else o_orderstatus end || '|' || o_orderpriority as cells from o""")
def parsed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders laid out in columns under two lines of headings, a third of the cells of one column empty, and read again."""
    status = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus"))
    line = F.concat(F.rpad(F.col("o_orderkey").cast("string"), 14, " "), F.rpad(status, 10, " "), "o_orderpriority")
    lines = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("l"))
    head = ["A list of orders.", "", "Order                   Priority", "key           status", "------------------------------"]
    texts = lines.select("o_custkey", F.array_join(F.concat(F.array(*map(F.lit, head)), F.col("l.line"), F.array(F.lit(""), F.lit("The end."))), "\n").alias("text"))
    found = layouts.parsed_tables(texts, by_gutters=True)
    return found.select("o_custkey", "ordinal", "first_line", F.array_join("headers", "|").alias("headers"), F.posexplode("matrix").alias("line", "row")).select("o_custkey", "ordinal", "first_line", "headers", "line", F.array_join("row", "|").alias("cells"))


