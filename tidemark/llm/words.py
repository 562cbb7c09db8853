"""Words of whole Arrow batches of texts, by numpy over their UTF-8 bytes.

ASCII white space never occurs inside a UTF-8 character, so words are found on
bytes; A-Z are lower-cased and nothing else is changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about so many bytes.
SLICE_BYTES = 4_000_000

_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_U = np.uint64


@dataclass
class Words:
    """``data``: lower-cased bytes with 8 zero bytes behind them; words are
    ``data[start : start + length]`` and belong to text ``doc`` (0 to n_docs - 1)."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    n_docs: int

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.length[i]].tobytes()

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def words_of_texts(texts: pa.Array) -> Words:
    """The words of each text; a null text has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    raw = texts.buffers()[2]
    n = last - first
    data = np.zeros(n + 8, np.uint8)
    if n:
        text = np.frombuffer(raw, np.uint8)[first:last]
        data[:n] = text + (text - np.uint8(ord("A")) < 26).view(np.uint8) * np.uint8(32)
    bounds = offsets - first if len(texts) else np.zeros(1, np.int64)
    word = np.zeros(n + 2, bool)
    word[1 : n + 1] = (data[:n] != 0x20) & (data[:n] - np.uint8(0x09) > 4)
    turns = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = turns[::2].copy(), turns[1::2].copy()
    inside = np.unique(bounds[word[bounds] & word[bounds + 1]])  # one text ends and the next begins without a space
    starts, ends = (np.insert(x, np.searchsorted(x, inside), inside) for x in (starts, ends))
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, bounds)))
    return Words(data, starts, ends - starts, doc, len(texts))


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(index of the first text, texts) in runs of about ``size`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // size
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True):
        yield int(a), texts.slice(int(a), int(b - a))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word, read in steps of eight bytes."""
    view = np.ndarray(len(words.data) - 7, "<u8", words.data, strides=(1,))
    h = mix(view[words.start] & _MASK[np.minimum(words.length, 8)] ^ (words.length.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
    long, step = np.flatnonzero(words.length > 8), 8
    while long.size:
        left = np.minimum(words.length[long] - step, 8)
        h[long] = mix(h[long] * _U(0x9E3779B97F4A7C15) + (view[words.start[long] + step] & _MASK[left]))
        step += 8
        long = long[words.length[long] > step]
    return h


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of many runs, one behind the other."""
    first = np.cumsum(length) - length
    return data[np.repeat(start - first, length) + np.arange(int(length.sum()))]
