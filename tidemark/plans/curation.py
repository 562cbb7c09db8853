"""Chunking and near-duplicate queries, each with its SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import chunks, near, structure
from tidemark.plans.catalogue import query
from tidemark.sources.tables import table

#: A namespace of identifiers of chunks.
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
_NS = "6ba7b8119dad11d180b400c04fd430c8"

_STRIP = lambda t: f"regexp_replace(regexp_replace({t}, '^\\s+', ''), '\\s+$', '')"
_TOKENS = lambda t: f"greatest(1, ceil(length({t}) / 4.0))::bigint"

_CHUNKS = f"""
n as (select doc_id, text, length(text) as n from documents where length(text) > 0),
w as (select doc_id, text, n, unnest(list_transform(range(0, (greatest(0, ceil((n - 1000) / 850.0)) + 1)::bigint), lambda i: i * 850)) as pos from n),
z as (select *, case when pos + 1000 < n and instr(reverse(substring(text, pos + 851, 150)), ' ') > 0 then pos + 850 + length(substring(text, pos + 851, 150)) - instr(reverse(substring(text, pos + 851, 150)), ' ') else least(pos + 1000, n) end as stop from w),
s as (select doc_id, pos, substring(text, pos + 1, stop - pos) as part from z),
p as (select doc_id, pos, '' as way, pos + length(part) - length(regexp_replace(part, '^\\s+', '')) as char_start, {_STRIP("part")} as chunk, 0 as depth from s),
r as (select * from p where chunk <> '' union all
  select doc_id, pos, way || half, start + length(part) - length(regexp_replace(part, '^\\s+', '')), {_STRIP("part")}, depth + 1 from (
    select doc_id, pos, way, depth, unnest(['a', 'b']) as half, unnest([char_start, char_start + cut]) as start, unnest([substring(chunk, 1, cut), substring(chunk, cut + 1)]) as part from (
      select *, case when b > 0 and length(h) - b > 0 then length(h) - b when f > 0 then length(chunk) // 2 + f - 1 else length(chunk) // 2 end as cut from (
        select *, substring(chunk, 1, length(chunk) // 2) as h, instr(reverse(substring(chunk, 1, length(chunk) // 2)), ' ') as b, instr(substring(chunk, length(chunk) // 2 + 1), ' ') as f
        from r where {_TOKENS("chunk")} > 64 and length(chunk) >= 2 and depth < 6))) where {_STRIP("part")} <> ''),
c as (select doc_id, row_number() over (partition by doc_id order by pos, way) - 1 as ordinal, char_start, char_start + length(chunk) as char_end, {_TOKENS("chunk")} as token_count, chunk
  from r where not ({_TOKENS("chunk")} > 64 and length(chunk) >= 2 and depth < 6))"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_documents(table(spark, sf_dir, "documents"), max_tokens=64)


@query(f"with recursive {_CHUNKS} select doc_id, ordinal, char_start, char_end, token_count, md5(chunk) as md5 from c")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "ordinal", "char_start", "char_end", "token_count", F.md5("chunk").alias("md5"))


@query("select doc_id, 0::bigint as uncovered, 0::bigint as wrong from documents where text is not null")
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks lose no character and stand where they say."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    own = _chunks(spark, sf_dir)
    wrong = chunks.wrong_offsets(own, docs).groupBy("doc_id").agg(F.count("*").alias("wrong"))
    return chunks.uncovered_characters(own, docs).join(wrong, "doc_id", "left").select("doc_id", "uncovered", F.coalesce("wrong", F.lit(0)).alias("wrong"))


@query(f"""
with h as (select o_orderkey, sha256(o_orderkey::varchar) as sha, (o_orderkey % 7) as a, (o_orderkey % 5) as b from orders),
d as (select o_orderkey, a, b, sha1(unhex('{_NS}') || encode(sha || ':' || a || ':' || b)) as s from h)
select o_orderkey, case when b > a then substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(s, 17, 1))::integer + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) end as chunk_id from d""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", chunks.chunk_id(NAMESPACE, F.sha2(key.cast("string"), 256), key % 7, key % 5).alias("chunk_id"))


@query(f"""with recursive {_CHUNKS}, t as (select doc_id, ordinal, case when doc_id % 5 = 0 and ordinal = 1 then chunk || '!' else chunk end as now, chunk from c)
select doc_id, count(*) as n_chunks, sha256(string_agg(sha256(now), '' order by ordinal)) as root, sha256(string_agg(sha256(now), '' order by ordinal)) = sha256(string_agg(sha256(chunk), '' order by ordinal)) as intact from t group by 1""")
def source_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose chunks were altered since they were attested have another root."""
    own = _chunks(spark, sf_dir)
    altered = own.withColumn("chunk", F.when((F.col("doc_id") % 5 == 0) & (F.col("ordinal") == 1), F.concat("chunk", F.lit("!"))).otherwise(F.col("chunk")))
    attested = chunks.root_hash(own, "doc_id").select("doc_id", F.col("root").alias("attested"))
    return chunks.root_hash(altered, "doc_id").join(attested, "doc_id").select("doc_id", "n_chunks", "root", (F.col("root") == F.col("attested")).alias("intact"))


_A, _B = (x.tolist() for x in near.permutations())


@query(f"""
with w as (select doc_id, lower(text) as t, regexp_extract_all(lower(text), '[A-Za-z0-9_\\-/]+') as w from documents where trim(text) <> ''),
v as (select doc_id, t, case when len(w) > 0 then w else [trim(t)] end as w from w),
s as (select doc_id, t, list_distinct(list_transform(range(0, greatest(len(w) - 3, 0) + 1), lambda i: array_to_string(w[i + 1:i + 3], ' '))) as s from v),
h as (select doc_id, list_transform(s, lambda x: ('0x' || substr(md5(x), 1, 8))::bigint) as h, sha256(trim(regexp_replace(t, '\\s+', ' ', 'g'))) as fingerprint from s),
k as (select fingerprint, min(doc_id) as first, arg_min(h, doc_id) as h from h group by 1),
x as (select first, unnest(h) as x from k), p as (select unnest({_A}) as a, unnest({_B}) as b, unnest(range(0, 128)) as i),
m as (select first, i, min((((a * (x >> 16)) % 4294967311 << 16) % 4294967311 + a * (x & 65535) + b) % 4294967311) as m from x, p group by all),
g as (select first, list(m order by i) as signature from m group by 1),
b as (select first, band, signature[band * 8 + 1:band * 8 + 8] as key from (select first, signature, unnest(range(0, 16)) as band from g)),
l as (select band, key, min(first) as leader from b group by all having count(*) > 1),
q as (select distinct b.first, l.leader from b join l using (band, key) where l.leader < b.first),
c as (select q.first, q.leader, round(len(list_filter(range(1, 129), lambda j: g1.signature[j] = g2.signature[j])) / 128, 6) as similarity from q join g g1 on g1.first = q.first join g g2 on g2.first = q.leader),
e as (select first, arg_max(leader, similarity * 1e9 - leader / 1e9) as leader, max(similarity) as similarity from c where similarity >= 0.8 group by 1)
select doc_id, case when doc_id <> k.first then k.first else coalesce(e.leader, doc_id) end as canonical_id,
  case when doc_id <> k.first then 'exact_text' when e.first is not null then 'minhash_lsh' else 'none' end as match_type, case when doc_id <> k.first then 1.0 else coalesce(e.similarity, 0.0) end::double as similarity
from h join k using (fingerprint) left join e on e.first = k.first""")
def minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On hashes that SQL has too; ``near_duplicates`` takes CRC-32 unless it is given others."""
    md5 = lambda x: int(hashlib.md5(x, usedforsecurity=False).hexdigest()[:8], 16)
    return near.near_duplicates(table(spark, sf_dir, "documents"), hashing=md5, least=0.8)


@query("""
with s as (select doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda x: x <> '') as s from documents),
k as (select doc_id, list_filter(list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[1:i], ' ')), lambda t: greatest(1, ceil(length(t) / 4.0)) <= 100) as k from s)
select doc_id, md5(k[len(k)]) as md5 from k""")
def sentence_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(chunks.trim_to_sentences(F.col("text"), 100)).alias("md5"))


#: Documents as regulations: every third line begins a section, others a clause, and blank lines stand between them.
_RULES = """select doc_id, array_to_string(list_transform(l, lambda x, i: case when i % 3 = 1 then 'SECTION ' || i || ' ' when i % 3 = 2 then '(' || i || ') ' else 'x ' end || x), chr(10) || chr(10)) as text, l
  from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' and not regexp_matches(x, '^[^a-zA-Z]*$')) as l from documents where text is not null) where len(l) > 0"""


@query(f"""
with t as ({_RULES}),
p as (select doc_id, l, unnest(range(1, len(l) + 1)) as i from t),
q as (select doc_id, i, case when i % 3 = 1 then 'SECTION ' || i || ' ' || l[i] when i % 3 = 2 then '(' || i || ') ' || l[i] else 'x ' || l[i] end as part, len(l) as n from p),
s as (select *, sum(length(part) + 2) over (partition by doc_id order by i) - length(part) - 2 as start from q)
select doc_id, i - 1 as ordinal, start::bigint as char_start, (start + length(rtrim(part, ' ')))::bigint as char_end,
  case when i % 3 = 1 and i < n then 'SECTION ' || i || '|(' || (i + 1) || ')' when i % 3 = 1 then 'SECTION ' || i when i % 3 = 2 then 'SECTION ' || (i - 1) || '|(' || i || ')' else 'SECTION ' || (i - 2) || '|(' || (i - 1) || ')' end as path,
  'section' as kind from s""")
def clause_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paragraph by itself, with its section and clause; paragraphs that begin a clause name it for the one before, too."""
    line = lambda x, i: F.concat(F.when((i + 1) % 3 == 1, F.format_string("SECTION %d ", i + 1)).when((i + 1) % 3 == 2, F.format_string("(%d) ", i + 1)).otherwise("x "), x)
    lines = F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~x.rlike("^[^a-zA-Z]*$"))
    texts = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", lines.alias("l")).filter("size(l) > 0")
    texts = texts.select("doc_id", F.array_join(F.transform("l", line), "\n\n").alias("text"))
    found = structure.structural_chunks(texts, structure.Limits(most=10**9, least=0))
    return found.select("doc_id", "ordinal", "char_start", "char_end", F.array_join("path", "|").alias("path"), "kind")


@query("""
select doc_id, 0::bigint as wrong, 0::bigint as uncovered, true as within from documents where trim(text) <> ''""")
def structure_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural chunks of the documents as they are stand where they say, hold at most 512 tokens and leave out white space only."""
    docs = table(spark, sf_dir, "documents").filter("trim(text) <> ''").select("doc_id", "text")
    own = structure.structural_chunks(docs)
    wrong = chunks.wrong_offsets(own, docs).groupBy("doc_id").agg(F.count("*").alias("wrong"))
    within = own.groupBy("doc_id").agg(F.bool_and((F.col("token_count") <= 512) | (F.instr("chunk", " ") == 0)).alias("within"))
    found = chunks.uncovered_characters(own, docs).join(wrong, "doc_id", "left").join(within, "doc_id")
    return found.select("doc_id", F.coalesce("wrong", F.lit(0)).alias("wrong"), "uncovered", "within")


@query("""
with t as (select page_id, 'Body of ' || url || chr(10) || 'Annexure ' || (page_id % 9 + 1) || ': Forms' || chr(10) || 'text' || case when page_id % 3 = 0 then chr(10) || 'Schedule ' || (page_id % 4 + 1) || chr(10) || 'rates' else '' end as text from pages),
c as (select page_id, text, instr(text, chr(10) || 'Annexure') as a, instr(text, chr(10) || 'Schedule') as s, length(text) as n from t)
select page_id, 1::bigint as ordinal, 'ANNEXURE' as kind, 'Annexure ' || (page_id % 9 + 1) as identifier, 'Forms' as title, a::bigint as char_start, case when s > 0 then s else n end::bigint as char_end, 0::bigint as parent from c
union all select page_id, 2, 'SCHEDULE', 'Schedule ' || (page_id % 4 + 1), 'Schedule ' || (page_id % 4 + 1), s::bigint, n::bigint, 0 from c where s > 0""")
def annexure_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    schedule = F.when(k % 3 == 0, F.format_string("\nSchedule %d\nrates", k % 4 + 1)).otherwise("")
    texts = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("Body of "), "url", F.format_string("\nAnnexure %d: Forms\ntext", k % 9 + 1), schedule).alias("text"))
    return structure.section_links(structure.sections(texts))
