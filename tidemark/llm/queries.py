"""The registered queries of the corpus operators and their SQL, where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import collocations, flac, jaccard_join, language_id, license_scan, merkle, nearest, packing, pitman_yor, secret_scan, sentencepiece_lattice, tool_calls, toxicity
from tidemark.llm.common import table


def op1_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from six sevenths of the documents, score all of them."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return pitman_yor.score(table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out")))


def op2_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text, decode it again, and say whether the text came back."""
    encoded = sentencepiece_lattice.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = sentencepiece_lattice.decode(encoded)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.replace("text", F.lit(sentencepiece_lattice.SPACE), F.lit(" "))).alias("round_trip"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, read as calls (user turns) and results (the replies)."""
    calls, results = tool_calls.calls_of_chat(table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.REPLY).drop("errors")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from two thirds of the documents, label all of them."""
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    model = language_id.fit(docs.filter(remainder != 1))
    found = language_id.label(docs, model)
    return found.select("doc_id", (remainder == 1).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op6_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates with the forest's decision; the value itself is given as a digest only."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "ordinal", "start", "n_chars", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as 8-bit FLAC, read back, with features of the samples."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = F.greatest(F.lit(1), F.ceil(F.length("raw") / 192)) * 192
    padded = F.concat("raw", F.encode(F.repeat(F.lit(" "), (size - F.length("raw")).cast("int")), "UTF-8"))
    texts = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    stored = flac.encode(texts.select("doc_id", F.length("raw").cast("long").alias("n_bytes"), padded.alias("payload")))
    read = flac.decode(stored)
    tail = F.expr("substring(pcm, -16)")
    return flac.with_features(read).select(
        "doc_id",
        "n_bytes",
        F.length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "ok",
    )


def op11_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from labels of two thirds of the ids, score all documents."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.labelled_texts(docs, table(spark, sf_dir, "labels")))
    return toxicity.classify(docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pitman_yor_scores": op1_pitman_yor_scores,
    "op2_sentencepiece_lattice": op2_sentencepiece_lattice,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_tool_calls": op4_tool_calls,
    "op5_language_id": op5_language_id,
    "op6_projected_neighbours": op6_projected_neighbours,
    "op7_license_scan": op7_license_scan,
    "op8_secret_scan": op8_secret_scan,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_flac_media": op10_flac_media,
    "op11_compression_toxicity": op11_compression_toxicity,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: All pairs that share a shingle, then the closure of the links: for small tables only.
_SIMILAR_GROUPS = r"""
with recursive texts as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when coalesce(len(w), 0) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from texts),
sizes as (select doc_id, len(s)::bigint as n_shingles from sets),
items as (select doc_id, unnest(s) as x from sets),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from items a join items b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as (
  select a, b from pairs p join sizes x on x.doc_id = p.a join sizes y on y.doc_id = p.b
  where 100 * shared >= 75 * (x.n_shingles + y.n_shingles - shared)),
edges as (select a, b from links union all select b, a from links),
reach as (select a, b from edges union select r.a, e.b from reach r join edges e on e.a = r.b)
select s.doc_id, s.n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) as component_id
from sizes s left join reach r on r.a = s.doc_id group by s.doc_id, s.n_shingles"""

_COLLOCATIONS = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from words group by lang),
grams as (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase from words, range(1, 5) t(m)),
f as (select lang, m, phrase, count(*)::hugeint as a from grams group by all having count(*) >= 30),
cand as (select * from f where m >= 2),
inside as (
  select lang, array_to_string(string_split(phrase, ' ')[i:i + k - 1], ' ') as phrase, max(a) as longer
  from cand, range(2, 4) x(k), range(1, 4) y(i) where k < m and i + k - 1 <= m group by all),
kept as (select c.* from cand c left join inside i using (lang, phrase) where longer is null or 100 * longer < 80 * a),
cuts as (
  select c.lang, c.phrase, c.a, k, l.a as l, r.a as r, 2000000 * c.a // (l.a + r.a) as score
  from (select *, array_to_string(string_split(phrase, ' ')[1:k], ' ') as p, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') as q from kept, range(1, 4) x(k) where k < m) c
  join f l on l.lang = c.lang and l.phrase = c.p join f r on r.lang = c.lang and r.phrase = c.q),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from best join totals using (lang) qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000"""


def _digest(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(({f})::varchar) || ':' || ({f})::varchar, '-')" for f in fields) + ")"


#: CRC-32 of a doc_id's decimal digits, bit by bit.
_CRC32 = """xor(4294967295, list_reduce([4294967295::ubigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint),
  lambda crc, b: list_reduce([xor(crc, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda x, y: xor(x >> 1, if(x & 1 = 1, 3988292384, 0)::ubigint))))"""

_MANIFEST = f"""
with recursive digests as (
  select row_number() over () as row, doc_id, lang, {_digest("n_chars")} as leaf, case when {_CRC32} % 7 = 0 then {_digest("n_chars + 1")} else {_digest("n_chars")} end as held from documents),
leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from digests),
nodes as (
  select lang, 0 as lvl, pos, leaf as h, n from leaves
  union all select lang, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), count(*) over (partition by lang) from nodes where n > 1 group by lang, lvl, pos // 2),
subs as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
top as (
  select 0 as lvl, pos, subroot as h, n from subs
  union all select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), count(*) over () from top where n > 1 group by lvl, pos // 2),
path as (
  select l.row, 0 as part, x.lvl, coalesce(if(s.pos < x.pos, 'L', 'R') || s.h, '') as s
  from leaves l join nodes x on x.lang is not distinct from l.lang and x.pos = l.pos >> x.lvl and x.n > 1
  left join nodes s on s.lang is not distinct from x.lang and s.lvl = x.lvl and s.pos = xor(x.pos, 1)
  union all
  select l.row, 1, x.lvl, coalesce(if(s.pos < x.pos, 'L', 'R') || s.h, '')
  from leaves l join subs u on u.lang is not distinct from l.lang join top x on x.pos = u.pos >> x.lvl and x.n > 1 left join top s on s.lvl = x.lvl and s.pos = xor(x.pos, 1)),
paths as (select row, list(s order by part, lvl) as p from path group by row),
folded as (
  select l.doc_id, l.leaf, u.subroot, (select h from top where n = 1) as root, sha256(coalesce(array_to_string(list_transform(p, lambda s: s[2:]), ''), '')) as proof_sha256,
    list_reduce([held] || coalesce(p, []), lambda x, s: case s[1] when 'L' then sha256(s[2:] || x) when 'R' then sha256(x || s[2:]) else sha256(x) end) as folded_root
  from leaves l join subs u on u.lang is not distinct from l.lang left join paths using (row))
select *, folded_root = root as verified from folded"""

ORACLE_SQL: dict[str, str] = {"op3_ngram_jaccard_join": _SIMILAR_GROUPS, "op12_phrase_collocations": _COLLOCATIONS, "op13_merkle_manifest": _MANIFEST}
