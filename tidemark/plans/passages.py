"""Queries on sentences, spans, words, hidden characters, quantities, tables and manifests, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quantities, scans, sentences
from tidemark.plans.catalogue import query
from tidemark.sources.tables import table

_SENTENCES = r"""
m as (select doc_id, regexp_replace(regexp_replace(text, '([.?!;]\s+)([A-Z0-9"''(\[\x{0900}-\x{097F}])', '\1' || chr(1) || '\2', 'g'), '(\n\s*\n+)', '\1' || chr(1), 'g') as t from documents),
p as (select doc_id, list_filter(string_split(t, chr(1)), lambda x: x <> '') as ps from m),
u as (select doc_id, unnest(ps) as piece, generate_subscripts(ps, 1) as pos from p),
f as (select *, regexp_matches(piece, '(^|\s)((?i:rs|inr|no|nos|sec|para|cl|art|e\.g|i\.e|viz|vs|v|dept|fig|approx|govt|ltd|pvt|co|dr|mr|mrs|ms|prof|rbi|sebi|cir)|\p{L})\.\s*$') as held,
  coalesce(sum(len(piece)) over before, 0) as place from u window before as (partition by doc_id order by pos rows between unbounded preceding and 1 preceding)),
g as (select *, coalesce(sum(case when held then 0 else 1 end) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as part from f),
j as (select doc_id, min(place) as place, string_agg(piece, '' order by pos) as t from g group by doc_id, part),
s as (select doc_id, (place + len(t) - len(regexp_replace(t, '^\s+', '')))::bigint as start, regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '') as sentence from j)
"""


@query(f"with {_SENTENCES} select doc_id, start, (start + len(sentence))::bigint as stop, md5(sentence) as digest from s where sentence <> ''")
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, sf_dir, "documents")).select("doc_id", F.col("start").cast("long"), F.col("end").cast("long").alias("stop"), F.md5("sentence").alias("digest"))


@query(f"""
with {_SENTENCES}, n as (select unnest(range(0, (select max(len(text)) // 850 + 1 from documents))) as w),
c as (select doc_id, start, w, least(start + len(sentence), w * 850 + 1000) - greatest(start, w * 850) as shared, len(sentence) as size
  from s join n on w * 850 < start + len(sentence) and w * 850 + 1000 > start where sentence <> ''),
r as (select doc_id, start, w, shared / (size + 1000 - shared) as iou, row_number() over (partition by doc_id, start order by shared / (size + 1000 - shared) desc, w) as k from c)
select doc_id, start, w as "window", iou from r where k = 1""")
def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentences.sentence_spans(table(spark, sf_dir, "documents"))
    return sentences.best_windows(found).select("doc_id", F.col("start").cast("long"), "window", "iou")


@query("""
with b as (select l_orderkey, l_linenumber, l_quantity as x, l_discount * 100 as y, l_quantity + l_tax * 100 as x1, l_discount * 100 + 10 as y1 from lineitem),
p as (select a.l_orderkey, a.l_linenumber as a_line, c.l_linenumber as b_line,
  greatest(0.0, least(a.x1, c.x1) - greatest(a.x, c.x)) * greatest(0.0, least(a.y1, c.y1) - greatest(a.y, c.y)) as shared,
  greatest(0.0, a.x1 - a.x) * greatest(0.0, a.y1 - a.y) + greatest(0.0, c.x1 - c.x) * greatest(0.0, c.y1 - c.y) as areas
  from b a join b c on a.l_orderkey = c.l_orderkey and a.l_linenumber < c.l_linenumber)
select l_orderkey, a_line, b_line, round(case when areas - shared > 0 then shared / (areas - shared) else 0.0 end, 6) as iou from p""")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made of the figures of the lines of one order."""
    y = F.col("l_discount") * 100
    box = F.struct(F.col("l_quantity").alias("x0"), y.alias("y0"), (F.col("l_quantity") + F.col("l_tax") * 100).alias("x1"), (y + 10).alias("y1"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"))
    other = lines.select("l_orderkey", F.col("l_linenumber").alias("b_line"), F.col("box").alias("b_box"))
    sides = [[F.col(f"{b}.{s}") for s in ("x0", "y0", "x1", "y1")] for b in ("box", "b_box")]
    pairs = lines.join(other, "l_orderkey").filter("l_linenumber < b_line")
    return pairs.select("l_orderkey", F.col("l_linenumber").alias("a_line"), "b_line", F.round(scans.box_iou(*sides), 6).alias("iou"))


@query("""
with w as (select distinct unnest(string_split(p_name, ' ')) as word from part), n as (select distinct lower(n_name) as name from nation)
select word, name, case when abs(len(word) - len(name)) > 2 then abs(len(word) - len(name)) else damerau_levenshtein(word, name) end::bigint as distance from w, n""")
def word_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names against the 25 names of nations, a fixed list."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    names = table(spark, sf_dir, "nation").agg(F.array_distinct(F.collect_list(F.lower("n_name"))).alias("names"))
    return words.join(F.broadcast(names)).select("word", F.explode("names").alias("name")).select("word", "name", sentences.osa_distance("word", "name").cast("long").alias("distance"))


_MARKED = r"""(select doc_id, case doc_id % 5 when 0 then chr(8203) || text when 1 then text || chr(27) || '[31m' when 2 then chr(8238) || text || chr(917569) else text end as text from documents)"""


@query(rf"""
with t as (select doc_id, text, array_to_string(list_filter([case when regexp_matches(text, '\x1B\[[0-9;]*[a-zA-Z]') then 'ansi' end,
  case when regexp_matches(text, '[\x{{E0000}}-\x{{E007F}}]') then 'unicode_tags' end,
  case when regexp_matches(text, '[\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}\x{{200E}}\x{{200F}}]') then 'bidi' end,
  case when regexp_matches(text, '[\x{{200B}}-\x{{200D}}\x{{FEFF}}\x{{2060}}\x{{180E}}\x{{00AD}}\x{{2061}}-\x{{2064}}\x{{FE00}}-\x{{FE0F}}]') then 'zero_width' end,
  case when regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{009F}}]') then 'control' end], lambda x: x is not null), ',') as classes from {_MARKED})
select doc_id, classes, md5(regexp_replace(regexp_replace(text, '\x1B\[[0-9;]*[a-zA-Z]', '', 'g'),
  '[\x{{E0000}}-\x{{E007F}}\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}\x{{200E}}\x{{200F}}\x{{200B}}-\x{{200D}}\x{{FEFF}}\x{{2060}}\x{{180E}}\x{{00AD}}\x{{2061}}-\x{{2064}}\x{{FE00}}-\x{{FE0F}}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{009F}}]', '', 'g')) as clean from t""")
def hidden_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, three fifths of which are given hidden characters first."""
    k = F.col("doc_id") % 5
    marked = F.when(k == 0, F.concat(F.lit("\u200b"), "text")).when(k == 1, F.concat("text", F.lit("\x1b[31m"))).when(k == 2, F.concat(F.lit("\u202e"), "text", F.lit("\U000e0041"))).otherwise(F.col("text"))
    texts = table(spark, sf_dir, "documents").select("doc_id", marked.alias("text"))
    return texts.select("doc_id", F.concat_ws(",", sentences.hidden_classes("text")).alias("classes"), F.md5(sentences.without_hidden("text")).alias("clean"))


#: Amounts in words, made of the price of an order.
_AMOUNT = """case o_orderkey % 9 when 0 then 'Rs. ' || round(o_totalprice / 1000)::bigint || ' crore' when 1 then '$ ' || round(o_totalprice / 1000)::bigint || ' million'
  when 2 then round(o_totalprice / 1000)::bigint || ' bps' when 3 then round(o_totalprice / 100000)::bigint || ' %' when 4 then 'about ' || round(o_totalprice / 1000)::bigint || ' lakh'
  when 5 then 'EUR ' || round(o_totalprice / 1000)::bigint || ',000.5' when 6 then 'no amount' when 7 then round(o_totalprice)::bigint || ' k' end"""


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    thousands, k = F.round(F.col("o_totalprice") / 1000).cast("long"), F.col("o_orderkey") % 9
    parts = [("Rs. ", thousands, " crore"), ("$ ", thousands, " million"), ("", thousands, " bps"), ("", F.round(F.col("o_totalprice") / 100000).cast("long"), " %"), ("about ", thousands, " lakh"), ("EUR ", thousands, ",000.5"), ("no amount", F.lit(""), ""), ("", F.round("o_totalprice").cast("long"), " k")]
    amount = F.lit(None).cast("string")
    for i, (a, b, c) in enumerate(parts):
        amount = F.when(k == i, F.concat(F.lit(a), b.cast("string"), F.lit(c))).otherwise(amount)
    return table(spark, sf_dir, "orders").select("o_orderkey", amount.alias("amount"))


_PARSED = f"""
a as (select o_orderkey, o_orderkey % 9 as k, {_AMOUNT} as amount, round(o_totalprice / 1000) as thousands, o_totalprice as price from orders),
q as (select o_orderkey, k, amount,
  case k when 0 then thousands * 1e7 when 1 then thousands * 1e6 when 2 then thousands * 1e-4 when 3 then round(price / 100000) * 1e-2 when 4 then thousands * 1e5 when 5 then thousands * 1000 + 0.5 when 7 then round(price) * 1e3 end as value,
  case k when 0 then 'INR' when 1 then 'USD' when 2 then 'BPS' when 3 then 'PERCENT' when 4 then 'INR' when 5 then 'EUR' else 'UNKNOWN' end as unit,
  case k when 0 then 'Crore' when 1 then 'Million' when 2 then 'bps' when 3 then '%' when 4 then 'Lakh' when 7 then 'Thousand' else 'unit' end as scale from a)
"""


@query(f"with {_PARSED} select o_orderkey, amount, value, unit, scale from q where amount is not null")
def parsed_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _amounts(spark, sf_dir).filter("amount is not null").select("o_orderkey", "amount", quantities.parse_quantity("amount").alias("q")).select("o_orderkey", "amount", "q.*")


@query(f"""
with {_PARSED} select a.o_orderkey, coalesce((abs(a.value - b.value) <= 0.001 or abs(a.value - b.value) <= 0.001 * greatest(abs(a.value), abs(b.value)))
  and (a.unit = 'UNKNOWN' or b.unit = 'UNKNOWN' or a.unit = b.unit or (a.unit in ('BPS', 'PERCENT') and b.unit in ('BPS', 'PERCENT'))), false) as same
from q a join q b on b.o_orderkey = a.o_orderkey + 1""")
def equivalent_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's amount against that of the next key."""
    rows = _amounts(spark, sf_dir).select("o_orderkey", quantities.parse_quantity("amount").alias("a"))
    after = rows.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("a").alias("b"))
    return rows.join(after, "o_orderkey").select("o_orderkey", quantities.equivalent(F.col("a"), F.col("b")).alias("same"))


@query(r"""
select c_custkey, count(*) as n_rows, '| o_orderkey | o_orderstatus | day |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
  string_agg('| ' || o_orderkey || ' | ' || replace(o_orderstatus, '|', '\|') || ' | ' || strftime(o_orderdate, '%Y-%m-%d') || ' |', chr(10) order by o_orderdate, o_orderkey) as markdown
from customer join orders on o_custkey = c_custkey group by c_custkey""")
def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return quantities.markdown_tables(rows.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")), "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus", "day"])


@query("""
select url, case when page_id % 7 = 3 then 'missing' when page_id % 11 = 5 then 'unlisted' when page_id % 5 = 1 then 'changed' else 'ok' end as state from pages""")
def manifest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of the pages' digests, a fifth of them outdated, against a store that lacks some pages and has others besides.

    Pages are told apart by their ids, as some have the url of another one.
    """
    pages, k = table(spark, sf_dir, "pages"), F.col("page_id")
    listed = pages.filter((k % 11 != 5) | (k % 7 == 3)).select("page_id", "url", F.sha2(F.when(k % 5 == 1, F.concat(F.coalesce("html", F.lit("")), F.lit(" "))).otherwise(F.col("html")), 256).alias("sha256"))
    stored = pages.filter(k % 7 != 3).select("page_id", "url", F.sha2("html", 256).alias("sha256"))
    return quantities.manifest_states(listed, stored, "page_id", ("url",)).select("url", "state")
