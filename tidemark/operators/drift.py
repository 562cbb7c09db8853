"""How far a term's latest definition has moved from its first one."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 384
#: What a word and its groups of three letters count (fixed values).
WORD, GROUP = 1.0, 0.5
#: Words that say nothing about a definition (fixed values).
STOPWORDS = set(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has "
    "have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own "
    "s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom "
    "why will with whose".split()
)
#: New words that a report names at most.
NAMED = 15


def hashed_vector(text: str, dimensions: int = DIMENSIONS, signed: bool = False) -> np.ndarray:
    """Words and groups of three letters, hashed into a vector of length one; a text without words points to the first dimension.

    ``signed``: half of the features count negatively, so that collisions cancel out on average (a count sketch).
    """
    parts = []
    for w in re.findall(r"\b[a-zA-Z0-9_-]+\b", text.strip().lower()):
        parts.append((w, WORD))
        parts.extend((w[i : i + 3], GROUP) for i in range(len(w) - 2))
    vector = np.zeros(dimensions, np.float32)
    if parts:
        hashes = np.array([zlib.crc32(p.encode()) for p, _ in parts], np.int64)
        weights = np.array([w for _, w in parts], np.float32)
        np.add.at(vector, hashes % dimensions, np.where(signed & (hashes // dimensions % 2 == 1), -weights, weights))
    norm = float(np.linalg.norm(vector))
    if not norm:
        vector[0] = 1.0
    return vector / norm if norm else vector


def moved(first: str, last: str) -> tuple[float, list[str]]:
    """(distance, new words in their order): 1 less the cosine of both vectors, 0 for equal texts."""
    if first.strip() == last.strip():
        return 0.0, []
    distance = max(0.0, 1.0 - min(1.0, float(hashed_vector(first) @ hashed_vector(last))))
    content = lambda t: [w for w in re.findall(r"\b[a-zA-Z0-9][a-zA-Z0-9_-]*\b", t.lower()) if w not in STOPWORDS and len(w) > 2]
    known = set(content(first))
    return round(distance, 4), list(dict.fromkeys(w for w in content(last) if w not in known))[:NAMED]


def drift(definitions: DataFrame, *, alert: float = 0.25) -> DataFrame:
    """(term, versions, distance, new_words, drifted) of each term, whatever its case.

    ``definitions``: (term, at, doc_id, text); of repeated ones of a document and a moment the greatest text counts, of several
    documents at a moment the smallest id comes first. Null terms, times and texts don't count; one version has not moved.
    """
    kept = definitions.filter("term is not null and at is not null and text is not null").select(F.lower(F.trim("term")).alias("term"), "at", "doc_id", "text")
    once = kept.groupBy("term", "at", "doc_id").agg(F.max("text").alias("text"))
    order = F.struct("at", "doc_id")
    ends = once.groupBy("term").agg(F.count("*").alias("versions"), F.min_by("text", order).alias("first"), F.max_by("text", order).alias("last"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [moved(a, b) for a, b in zip(batch.column("first").to_pylist(), batch.column("last").to_pylist(), strict=True)]
            far = pa.array([d for d, _ in out], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("versions"), far, pa.array([w for _, w in out], pa.list_(pa.string())), pa.array([d >= alert for d, _ in out])], ["term", "versions", "distance", "new_words", "drifted"])

    return ends.mapInArrow(measure, "term string, versions long, distance double, new_words array<string>, drifted boolean")
