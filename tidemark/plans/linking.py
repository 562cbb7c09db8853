"""Registered queries of dictionaries, references and the search over all arms, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import dictionary, hybrid, measures
from tidemark.plans.catalogue import query
from tidemark.sources.tables import table

#: Words, their places, and the hits of a dictionary ``p`` of (entity_id, phrase, confidence) in documents.
_HITS = r"""
words as (select doc_id, regexp_extract_all(text, '[\pL\pN_-]+') as w, string_split_regex(text, '[\pL\pN_-]+') as g from documents where text is not null),
spans as (
  select doc_id, i, lower(w[i]) as word, sum(len(g[i]) + len(w[i])) over (partition by doc_id order by i) - len(w[i]) as s, sum(len(g[i]) + len(w[i])) over (partition by doc_id order by i) as e
  from (select *, unnest(range(1, len(w) + 1)) as i from words)),
known as (select phrase, entity_id, confidence, string_split(phrase, ' ') as pw from (select *, row_number() over (partition by phrase order by confidence desc, entity_id) as r from p) where r = 1),
hits as (
  select a.doc_id, k.phrase, k.entity_id, k.confidence, a.s, max(b.e) as e
  from known k join spans a on a.word = k.pw[1] join spans b on b.doc_id = a.doc_id and b.i between a.i and a.i + len(k.pw) - 1 and b.word = k.pw[b.i - a.i + 1]
  group by all having count(*) = any_value(len(k.pw)))"""

#: Each item of the benchmark is an entity: its first three words, its next two, and its last two are its names.
_NAMES = r"""
named as (select item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\pL\pN_\s-]', ' ', 'g'), '\s+'), lambda w: w <> '') as w from benchmark),
p as (
  select distinct * from (
    select item_id as entity_id, array_to_string(w[1:3], ' ') as phrase, 1.0::double as confidence from named
    union all select item_id, array_to_string(w[4:5], ' '), 0.95 from named
    union all select item_id, array_to_string(w[-2:], ' '), 0.88 from named) where phrase <> '')"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), r"(?U)[^\w\s-]", " "), r"\s+"), lambda x: x != "")
    named = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w"))
    phrases = F.array(
        F.struct(F.concat_ws(" ", F.slice("w", 1, 3)).alias("phrase"), F.lit(1.0).alias("confidence")),
        F.struct(F.concat_ws(" ", F.slice("w", 4, 2)).alias("phrase"), F.lit(0.95).alias("confidence")),
        F.struct(F.concat_ws(" ", F.slice("w", F.greatest(F.lit(1), F.size("w") - 1), 2)).alias("phrase"), F.lit(0.88).alias("confidence")),
    )
    return named.select(F.col("item_id").alias("entity_id"), F.inline(phrases))


@query(f"""
with {_NAMES}, {_HITS},
folded as (
  select doc_id, list_reduce(list([{{s: s, e: e, phrase: phrase, entity_id: entity_id, confidence: confidence}}] order by s, -e), lambda a, x: if(x[1].s >= a[-1].e, a || x, a)) as h
  from hits group by doc_id)
select doc_id, x.phrase, x.entity_id, x.confidence, x.s::int as char_start, x.e::int as char_end from (select doc_id, unnest(h) as x from folded)""")
def phrase_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leftmost-longest mentions of the benchmark's names in all documents, with offsets."""
    return dictionary.phrase_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), _names(spark, sf_dir))


@query(f"""
with {_NAMES}, {_HITS}
select doc_id, entity_id, max(confidence) as confidence, count(*) as mentions, min(s)::int as first_start from hits where confidence >= 0.9 group by all""")
def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of each document by all of their names of at least 0.9."""
    hits = dictionary.phrase_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), _names(spark, sf_dir), overlaps="all")
    return dictionary.linked_entities(hits, "doc_id", least=0.9)


_LETTER = """'In terms of circular RBI/2024-25/' || {key} || ' read with DOR.STR.REC.' || {cust} || '/21.04.048/2024-25, and SEBI/HO/' || {status} || '/P/' || {other} || ', all entities shall comply with what is set out below.'"""


@query(f"""
with letters as (select o_orderkey as doc_id, {_LETTER.format(key="o_orderkey // 3", cust="o_custkey", status="o_orderstatus", other="o_orderkey % 50")} as text from orders),
found as (
  select doc_id, text, unnest(regexp_extract_all(text, 'RBI/[0-9]{{4}}-[0-9]{{2,4}}/[0-9]+|DOR(?:\\.[A-Za-z0-9_-]+)+(?:/[A-Za-z0-9_.()-]*[A-Za-z0-9_])*|SEBI/[A-Za-z0-9_/-]+')) as reference from letters),
placed as (select doc_id, reference, instr(text, reference) - 1 as s, text from found),
manifest as (
  select o_orderkey * 2 as place, upper('RBI/2024-25/' || o_orderkey) as name, o_orderkey as target from orders where o_orderkey % 5 = 0
  union all select o_orderkey * 2 + 1, upper('DOR.STR.REC.' || o_custkey || '/'), o_orderkey from orders where o_orderkey % 7 = 0
  union all select o_orderkey * 2, upper('x/SEBI/HO/' || o_orderstatus || '/P/' || o_orderkey % 50 || '/y'), o_orderkey from orders where o_orderkey % 11 = 0),
asked as (select distinct upper(reference) as clean from placed),
targets as (
  select clean, (select max_by(target, place) from manifest where name = clean) as exact, (select min_by(target, place) from manifest where contains(clean, name) or contains(name, clean)) as partly from asked)
select doc_id, reference, s::int as char_start, (s + len(reference))::int as char_end, trim(substr(text, greatest(0, s - 40)::int + 1, (s + len(reference) + 40 - greatest(0, s - 40))::int)) as context, coalesce(exact, partly) as target
from placed join targets on clean = upper(reference)""")
def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of letters that are made of orders, resolved against a manifest that is made of orders as well."""
    orders = table(spark, sf_dir, "orders")
    letter = F.format_string(
        "In terms of circular RBI/2024-25/%d read with DOR.STR.REC.%d/21.04.048/2024-25, and SEBI/HO/%s/P/%d, all entities shall comply with what is set out below.",
        F.expr("o_orderkey div 3"), "o_custkey", "o_orderstatus", F.col("o_orderkey") % 50,
    )
    found = dictionary.references(orders.select(F.col("o_orderkey").alias("doc_id"), letter.alias("text")), "doc_id")
    key = F.col("o_orderkey")
    manifest = orders.filter(key % 5 == 0).select((key * 2).alias("place"), F.concat(F.lit("RBI/2024-25/"), key).alias("name"), key.alias("target"))
    manifest = manifest.unionAll(orders.filter(key % 7 == 0).select(key * 2 + 1, F.concat(F.lit("DOR.STR.REC."), "o_custkey", F.lit("/")), key))
    manifest = manifest.unionAll(orders.filter(key % 11 == 0).select(key * 2, F.format_string("x/SEBI/HO/%s/P/%d/y", "o_orderstatus", key % 50), key))
    return dictionary.resolved(found, manifest)


_HYBRID = r"""
docs as (select doc_id, text, coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as integer), 0) % 5 + 1 as tier from documents where lang in ('en', 'fr')),
d as (select doc_id, unnest(string_split_regex(lower(text), '\s+')) as term from docs),
tf as (select doc_id, term, count(*) as tf from d where term <> '' group by all),
len as (select doc_id, sum(tf) as dl from tf group by all),
st as (select count(*) as n, avg(dl) as avgdl from len),
df as (select term, count(*) as df from tf group by all),
q as (select distinct item_id, unnest(string_split_regex(lower(text), '\s+')) as term from benchmark),
bm as (select item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from q join tf using (term) join df using (term) join len using (doc_id), st where term <> '' group by all),
lexical as (select * from (select item_id, doc_id, row_number() over (partition by item_id order by score desc, doc_id) as rank from bm) where rank <= 20),
v as (select vec_id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm from embeddings),
cs as (select a.vec_id as item_id, b.vec_id as doc_id, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 6) as score
  from v a join benchmark on item_id = a.vec_id, v b where b.vec_id in (select doc_id from docs)),
dense as (select * from (select item_id, doc_id, row_number() over (partition by item_id order by score desc, doc_id) as rank from cs) where rank <= 20),
ways as (
  select distinct src, dst, relation from (select doc_id as src, doc_id // 2 as dst, 'cites' as relation from documents union all select doc_id, doc_id // 3, 'amends' from documents)
  where src <> dst and src in (select doc_id from docs) and dst in (select doc_id from docs)),
seeds as (select item_id, doc_id from lexical where rank <= 3),
hop1 as (select item_id, dst as doc_id, max(if(relation = 'amends', 0.9, 0.7) * 0.85) as score from seeds join ways on src = doc_id group by all),
hop2 as (select item_id, dst as doc_id, max(if(relation = 'amends', 0.9, 0.7) * 0.7225) as score from hop1 join ways on src = doc_id group by all),
gs as (select item_id, doc_id, round(max(score), 9)::double as score from (select * from hop1 union all select * from hop2) anti join seeds using (item_id, doc_id) group by all),
graph as (select * from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from gs) where rank <= 20),
u as (
  select 'lexical' as arm, item_id, doc_id, rank, 1.0 / (60 + rank) as term from lexical union all select 'dense', item_id, doc_id, rank, 1.0 / (60 + rank) from dense
  union all select 'graph', item_id, doc_id, rank, 0.5 * (1 + 0.1 * score) / (60 + rank) from graph),
fu as (select item_id, doc_id, round(sum(term::double), 9) as score, string_agg(arm || '=' || rank, ',' order by arm) as arm_ranks from u group by all),
cen as (select dst as doc_id, round(count(*) / max(count(*)) over (), 9) as c from ways group by dst),
f as (
  select item_id, doc_id, arm_ranks, round(score * (1 + 0.15 * ln(1 + coalesce(c, 0) * (exp(1) - 1))) * case tier when 1 then 1.25 when 2 then 1.15 when 3 then 1.05 when 5 then 0.85 else 1.0 end::double, 9) as score
  from fu join docs using (doc_id) left join cen using (doc_id)),
b as (select item_id, doc_id, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from f) where rank <= 5),
l as (select item_id, doc_id, min(arm) as anchored_arm from u where rank = 1 group by all),
m as (select l.*, f.score, row_number() over (partition by l.item_id order by anchored_arm, l.doc_id) as n from l join f using (item_id, doc_id) anti join b on b.item_id = l.item_id and b.doc_id = l.doc_id),
x as (select item_id, count(*) as extra from m group by all),
k as (select b.* from b left join x using (item_id) where rank <= greatest(0, 5 - coalesce(extra, 0))),
h as (select item_id, count(*) as have from k group by all),
found as (
  select item_id, doc_id, score, rank, null::varchar as anchored_arm from k
  union all select m.item_id, doc_id, score, coalesce(have, 0) + n, anchored_arm from m left join h using (item_id) where coalesce(have, 0) + n <= 5)"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors, key = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), F.col("doc_id")
    items = table(spark, sf_dir, "benchmark")
    edges = docs.select(key.alias("src"), F.expr("doc_id div 2").alias("dst"), F.lit("cites").alias("relation")).unionAll(docs.select(key, F.expr("doc_id div 3"), F.lit("amends")))
    tier = F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)"), F.lit(0)) % 5 + 1
    asked = vectors.select(F.col("vec_id").alias("item_id"), "embedding").join(items.select("item_id"), "item_id")
    return hybrid.hybrid_search(
        items, docs, asked, vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), edges,
        keep=F.col("lang").isin("en", "fr"), tier=tier, how=hybrid.Search(relations={"amends": 0.9, "cites": 0.7}),
    )


@query(f"with {_HYBRID} select item_id, doc_id, score, rank, arm_ranks, anchored_arm from found join fu using (item_id, doc_id)".replace("select item_id, doc_id, score, rank, arm_ranks", "select item_id, doc_id, found.score, rank, arm_ranks"))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items against the English and French documents by words, vectors and citations."""
    return _hybrid(spark, sf_dir)


_PASSAGES = r"""
named as (select item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\pL\pN_\s-]', ' ', 'g'), '\s+'), lambda w: w <> '') as w from benchmark),
p as (select item_id as entity_id, array_to_string(w[1:6], ' ') as phrase, 1.0::double as confidence from named)"""


@query(f"""
with {_HYBRID}, {_PASSAGES}, {_HITS},
truth as (select distinct entity_id as item_id, doc_id from hits where doc_id in (select doc_id from docs)),
asked as (select item_id, count(*) as n from truth group by all),
got as (select item_id, count(*) as covered, sum(1 / log2(rank + 1)) as dcg, min(rank) as best from found join truth using (item_id, doc_id) group by all)
select item_id, round(coalesce(covered, 0) / n, 6) as recall, coalesce(covered, 0) > 0 as hit, round(coalesce(1 / best, 0), 6) as reciprocal_rank,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg
from asked left join got using (item_id)""")
def hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, reciprocal rank and nDCG of the search: documents that hold the first six words of an item are what it looks for."""
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), r"(?U)[^\w\s-]", " "), r"\s+"), lambda x: x != "")
    phrases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entity_id"), F.concat_ws(" ", F.slice(w, 1, 6)).alias("phrase"), F.lit(1.0).alias("confidence"))
    docs = table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "fr")).select("doc_id", "text")
    truth = dictionary.phrase_hits(docs, phrases, overlaps="all").select(F.col("entity_id").alias("item_id"), "doc_id").distinct().withColumn("group", F.col("doc_id"))
    return measures.group_scores(_hybrid(spark, sf_dir).select("item_id", "doc_id", "rank"), truth, "item_id", "doc_id", k=5)
