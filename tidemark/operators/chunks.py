"""Chunks of texts that know where they stand, and their identifiers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: How often a chunk may be halved at most.
MOST_HALVINGS = 6


def last_space(text: Column) -> Column:
    """The place (from 0) of the last space of a text, or -1."""
    back = F.locate(" ", F.reverse(text))
    return F.when(back > 0, F.length(text) - back).otherwise(-1)


def approximate_tokens(text: Column) -> Column:
    """Four characters to a token, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def placed_strip(text: str, start: int) -> tuple[int, str]:
    """(start, text) without white space at the ends."""
    return start + len(text) - len(text.lstrip()), text.strip()


def middle_space(text: str) -> int:
    """The space before a text's middle, else the first behind it, else its middle."""
    middle = len(text) // 2
    for found in (text.rfind(" ", 0, middle), text.find(" ", middle)):
        if found > 0:
            return found
    return middle


def halves(text: str, start: int, count: Callable[[str], int], most: int, cut: Callable[[str], int], *, shortest: int = 2, depth: int | None = None) -> Iterator[tuple[int, str, int]]:
    """(start, text, tokens) of a text that is halved, in its order, until each piece has at most ``most`` tokens, or is too short or often halved."""
    waiting = [(start, text, 0)]
    while waiting:
        at, piece, done = waiting.pop()
        tokens = count(piece)
        if tokens <= most or len(piece) < shortest or (depth is not None and done >= depth):
            yield at, piece, tokens
            continue
        k = cut(piece)
        for offset, part in ((k, piece[k:]), (0, piece[:k])):
            begin, bare = placed_strip(part, at + offset)
            if bare:
                waiting.append((begin, bare, done + 1))


def quarter_tokens(text: str) -> int:
    return max(1, -(-len(text) // 4))


def window_pieces(text: str, size: int, overlap: int, count: Callable[[str], int], most: int) -> Iterator[tuple[int, str, int]]:
    """(start, text, tokens) of the pieces of all windows of one text."""
    step, n = size - overlap, len(text)
    for pos in range(0, n, step):
        end = min(pos + size, n)
        if end < n and (space := text.rfind(" ", pos + step, end)) > pos:
            end = space
        start, body = placed_strip(text[pos:end], pos)
        if body:
            yield from halves(body, start, count, most, middle_space, depth=MOST_HALVINGS)
        if pos + size >= n:
            break


#: Rows that are handed on together.
HANDED_ON = 5_000


def rows_of_texts(texts: DataFrame, cut: Callable[[str], Iterable[tuple]], columns: str) -> DataFrame:
    """The other columns of ``texts`` and the ``columns`` of every row that ``cut`` makes of its text (none of a null text)."""
    kept = [c for c in texts.columns if c != "text"]
    made = StructType.fromDDL(columns)
    schema = StructType([*(texts.schema[c] for c in kept), *made])
    kinds = to_arrow_schema(made)

    def batch(own: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], kind.type) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*own.take(pa.array(at, pa.int64())).columns, *columns], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            own, at, rows = full.select(kept), [], []
            for i, text in enumerate(full.column(len(kept))):
                for row in cut(text.as_py()) if text.is_valid else ():
                    at.append(i)
                    rows.append(row)
                    if len(rows) >= HANDED_ON:
                        yield batch(own, at, rows)
                        at, rows = [], []
            if rows:
                yield batch(own, at, rows)

    return texts.select(*kept, "text").mapInArrow(run, schema)


def chunk_documents(docs: DataFrame, *, size: int = 1000, overlap: int = 150, max_tokens: int = 512) -> DataFrame:
    """(doc_id, ordinal, char_start, char_end, token_count, chunk) of the windows of each text.

    A window ends at the last space of its overlap, if there is one, so the next
    one begins before its end and nothing is lost.  Ends are stripped, blank ones
    go, and what has more than ``max_tokens`` is halved at the space before its
    middle, else the first behind it, else in the middle.  ValueError for an
    overlap that isn't smaller than the size; null and blank texts have no chunks.
    All windows of a text are cut in one go, in time that grows with its length.
    """
    if not 0 <= overlap < size:
        raise ValueError(f"the overlap ({overlap}) must be smaller than the size ({size})")

    def cut(text: str) -> Iterator[tuple]:
        for i, (start, piece, tokens) in enumerate(window_pieces(text, size, overlap, quarter_tokens, max_tokens)):
            yield i, start, start + len(piece), tokens, piece

    return rows_of_texts(docs.select("doc_id", "text"), cut, "ordinal long, char_start long, char_end long, token_count long, chunk string")


def wrong_offsets(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """The chunks whose text isn't what stands at their place."""
    own = chunks.join(docs.select("doc_id", "text"), "doc_id")
    there = F.substring("text", (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int"))
    return own.filter(~there.eqNullSafe(F.col("chunk"))).select("doc_id", "ordinal")


def uncovered_characters(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, uncovered): characters that are no white space and stand in no chunk."""
    from pyspark.sql.window import Window

    upto = Window.partitionBy("doc_id").orderBy("char_start", "char_end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = chunks.select("doc_id", "char_start", F.coalesce(F.max("char_end").over(upto), F.lit(0)).alias("from"))
    ends = chunks.groupBy("doc_id").agg(F.max("char_end").alias("from"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    inner = gaps.filter("char_start > from").join(texts, "doc_id").select("doc_id", F.expr("substring(text, cast(from + 1 as int), cast(char_start - from as int))").alias("gap"))
    tail = texts.join(ends, "doc_id", "left").select("doc_id", F.expr("substring(text, cast(coalesce(from, 0) + 1 as int))").alias("gap"))
    every = inner.unionAll(tail)
    return every.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("gap", r"\s", ""))).alias("uncovered"))


def named_uuid(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name in a namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-", *parts)


def chunk_id(namespace: str, version_sha256: Column, start: Column, end: Column) -> Column:
    """A chunk's identifier, which its version and place decide; null for a digest or a span that isn't one."""
    good = version_sha256.rlike("^[0-9a-f]{64}$") & (start >= 0) & (end > start)
    return F.when(good, named_uuid(namespace, F.concat_ws(":", version_sha256, start.cast("string"), end.cast("string"))))


def root_hash(chunks: DataFrame, key: str) -> DataFrame:
    """(key, n_chunks, root): a digest of the digests of a document's chunks in their order."""
    digests = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.sha2("chunk", 256).alias("digest")))).alias("all"))
    return digests.select(key, F.size("all").cast("long").alias("n_chunks"), F.sha2(F.array_join(F.col("all.digest"), ""), 256).alias("root"))


def trim_to_sentences(text: Column, budget: int) -> Column:
    """The longest run of whole sentences from the start that has at most ``budget`` tokens; null if not even one has."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")

    def add(state: Column, sentence: Column) -> Column:
        longer = F.when(state["text"] == "", sentence).otherwise(F.concat_ws(" ", state["text"], sentence))
        fits = state["open"] & (approximate_tokens(longer) <= budget)
        return F.struct(F.when(fits, longer).otherwise(state["text"]).alias("text"), fits.alias("open"))

    return F.nullif(F.aggregate(parts, F.struct(F.lit("").alias("text"), F.lit(True).alias("open")), add)["text"], F.lit(""))
