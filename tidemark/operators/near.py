"""Near duplicates by MinHash signatures and bands.

Signatures are computed by numpy over Arrow batches; bands are grouped, and every
member of a band is compared with the band's first document only, so a band that a
third of all texts share gives as many pairs as it has members.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import materialise

#: The modulus of the permutations (a prime above 2^32; fixed value).
MODULUS = 4294967311
PERMUTATIONS, BANDS, SHINGLE, SEED = 128, 16, 3, 42
#: Similarity of signatures from which two texts are near duplicates.
LEAST = 0.98


def permutations(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The factors and summands of ``n`` permutations."""
    rng = np.random.RandomState(seed)
    return rng.randint(1, MODULUS, size=n, dtype=np.int64), rng.randint(0, MODULUS, size=n, dtype=np.int64)


_WORD = re.compile(r"[A-Za-z0-9_\-/]+")


def shingles(text: str, size: int = SHINGLE) -> list[str]:
    """The different word shingles of a text in lower case; a short text is one shingle, a blank one has none."""
    if not text.strip():
        return []
    words = _WORD.findall(text.lower()) or [text.strip().lower()]
    return sorted({" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))})


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each permutation over 32-bit hashes, in exact arithmetic."""
    # a * x mod MODULUS by halves of x, which fit in 64 bits
    high = (a[:, None] * (hashes >> 16)) % MODULUS
    return (((high << 16) % MODULUS + a[:, None] * (hashes & 0xFFFF) + b[:, None]) % MODULUS).min(axis=1)


def signatures(docs: DataFrame, hashing: Callable[[bytes], int] = zlib.crc32) -> DataFrame:
    """(doc_id, fingerprint, signature) of each text that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations()
        for batch in batches:
            found = [shingles(t or "") for t in batch["text"].to_pylist()]
            rows = [i for i, s in enumerate(found) if s]
            made = [signature(np.array([hashing(x.encode()) for x in found[i]], np.int64), a, b) for i in rows]
            kept = batch.select(["doc_id", "fingerprint"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(made, pa.list_(pa.int64()))], names=["doc_id", "fingerprint", "signature"])

    fingerprint = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)
    rows = docs.select(F.col("doc_id").cast("long"), fingerprint.alias("fingerprint"), "text")
    return rows.mapInArrow(run, "doc_id long, fingerprint string, signature array<bigint>")


def similarity(a: str, b: str) -> Column:
    """The share of equal places of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def near_duplicates(docs: DataFrame, *, hashing: Callable[[bytes], int] = zlib.crc32, bands: int = BANDS, least: float = LEAST) -> DataFrame:
    """(doc_id, canonical_id, match_type, similarity) of each text.

    The canonical document is the first with the same fingerprint, else the most
    similar of the first documents of the text's bands (ties to the smaller id),
    if it is similar enough; a text without one is its own, with match "none".
    Blank texts take no part; ids must be unique.
    """
    rows = materialise(signatures(docs, hashing), "near-signatures")
    rows_per_band = PERMUTATIONS // bands
    keyed = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.min_by("signature", "doc_id").alias("signature"))
    keyed = materialise(keyed, "near-texts")
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice("signature", i * rows_per_band + 1, F.lit(rows_per_band))).alias("key")))
    banded = keyed.select("first", F.inline(keys))
    leaders = banded.groupBy("band", "key").agg(F.min("first").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = banded.join(leaders, ["band", "key"]).filter("leader < first").select("first", "leader").distinct()
    other = keyed.select(F.col("first").alias("leader"), F.col("signature").alias("there"))
    scored = pairs.join(keyed, "first").join(other, "leader").select("first", "leader", F.round(similarity("signature", "there"), 6).alias("similarity"))
    best = scored.filter(F.col("similarity") >= least).groupBy("first").agg(F.max(F.struct("similarity", (-F.col("leader")).alias("minus"))).alias("best"))
    found = rows.join(keyed.select("fingerprint", "first"), "fingerprint").select("doc_id", "first").join(best, "first", "left")
    copy, near = F.col("doc_id") != F.col("first"), F.col("best").isNotNull()
    return found.select(
        "doc_id",
        F.when(copy, F.col("first")).when(near, -F.col("best.minus")).otherwise(F.col("doc_id")).alias("canonical_id"),
        F.when(copy, "exact_text").when(near, "minhash_lsh").otherwise("none").alias("match_type"),
        F.when(copy, 1.0).when(near, F.col("best.similarity")).otherwise(0.0).alias("similarity"),
    )
