"""Language of whole texts and of the spans in them.

A word's script (by ranges of its letters) narrows its candidate languages to
those seen in that script in training; each word then has a score per language
from byte trigrams, and Viterbi with a switching penalty labels the words, so
that a mixed text falls into spans.

The model is a table of 65,536 hashed trigrams for each language: its size does
not depend on the data.  Counts are taken from all training rows.

Defined cases: a null text, or one without any letter, is ``und`` with score 0
and no spans; words without a letter carry no evidence; ties go to the language
that sorts first; repeated rows are labelled once each; without training rows
every text is ``und``; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import Words, slices, words_of_texts

FEATURES = 1 << 16
UNKNOWN = "und"
#: Nats that a change of language must win.
SWITCH = 12.0
#: A language is a candidate for a script that so much of its words have.
SCRIPT_SHARE = 0.001
_LETTER = regex.compile(r"\p{L}")

#: First code points of ranges of letters and the script of each (fixed values);
#: a range ends where the next one starts.
SCRIPT_RANGES = [
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"),
    (0x00C0, "latin"), (0x0250, "phonetic"), (0x02B0, "none"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "nko"),
    (0x0800, "samaritan"), (0x0840, "mandaic"), (0x0860, "syriac"), (0x0870, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2C00, "glagolitic"),
    (0x2C60, "latin"), (0x2C80, "coptic"), (0x2D00, "georgian"), (0x2D30, "tifinagh"), (0x2D80, "other"), (0x2DE0, "none"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0x10000, "other"), (0x20000, "han"), (0x30000, "other"),
]
#: Letters that stand alone in a range without letters (modifiers, letter-like signs).
SIGN = "sign"
SCRIPTS = sorted({SIGN, *(name for _, name in SCRIPT_RANGES)})
_FIRST = np.array([a for a, _ in SCRIPT_RANGES])
_OF_RANGE = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES], np.uint8)
_NONE = SCRIPTS.index("none")


def _script_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The script of each code point of up to three bytes; the script by a character's
    first two bytes, and whether these leave it open (then the third one decides)."""
    points = np.arange(1 << 16)
    by_point = _OF_RANGE[np.searchsorted(_FIRST, points, side="right") - 1]
    open_points = np.flatnonzero(by_point == _NONE)
    signs = [p for p in open_points.tolist() if not 0xD800 <= p < 0xE000 and _LETTER.match(chr(p))]
    by_point[signs] = SCRIPTS.index(SIGN)
    code = np.arange(1 << 16)
    lead, second = code >> 8, code & 0x3F
    three = lead >> 4 == 14
    point = np.where(lead < 0x80, lead, 0)
    point = np.where(lead >> 5 == 6, (lead & 0x1F) << 6 | second, point)
    point = np.where(three, (lead & 0x0F) << 12 | second << 6, point)
    point = np.where(lead >> 3 == 30, (lead & 0x07) << 18 | second << 12, point)
    by_bytes = np.where(lead >> 3 == 30, _OF_RANGE[np.searchsorted(_FIRST, point, side="right") - 1], by_point[point & 0xFFFF])
    cells = by_point.reshape(-1, 64)
    split = (cells != cells[:, :1]).any(axis=1)
    return by_point, by_bytes, three & split[point >> 6 & 0x3FF]


_BY_POINT, _BY_BYTES, _OPEN = _script_tables()


@dataclass
class Model:
    langs: list[str]
    #: [feature, language] log probabilities.
    logp: np.ndarray
    #: [script, language]: is the language a candidate for words in the script?
    candidate: np.ndarray


def _byte_features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its script, and for each byte of the words its hashed trigram; where words start in these."""
    first = np.cumsum(words.length) - words.length
    at = np.repeat(words.start - first, words.length) + np.arange(int(words.length.sum()))
    b = words.data.astype(np.uint32)
    before = b[at - 1]
    before[first] = 0x20
    after = b[at + 1]
    after[first + words.length - 1] = 0x20
    code = before << 16 | b[at] << 8 | after
    feature = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    pair = b[at] << 8 | after
    kind = _BY_BYTES[pair]
    third = np.flatnonzero(_OPEN[pair])
    kind[third] = _BY_POINT[(pair[third] >> 8 & 0x0F) << 12 | (pair[third] & 0x3F) << 6 | b[at[third] + 2] & 0x3F]
    kind = np.where(b[at] >> 6 == 2, _NONE, kind)  # inside a character
    lettered = np.where(kind != _NONE, np.arange(len(at)), len(at))
    lead = np.minimum.reduceat(lettered, first) if len(first) else np.empty(0, np.int64)
    script = np.append(kind, _NONE)[np.where(lead < first + words.length, lead, len(at))]
    return script, feature, first


def fit(rows: DataFrame, *, smoothing: float = 0.5) -> Model:
    """Learn from all ``rows`` (text, lang) whose language is not null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: Counter = Counter()
        for batch in batches:
            lang = np.array(batch["lang"].to_pylist(), object)
            for a, texts in slices(batch["text"]):
                own = lang[a : a + len(texts)]
                for name in sorted(set(own)):
                    words = words_of_texts(texts.filter(pa.array(own == name)))
                    script, feature, _ = _byte_features(words)
                    grams.setdefault(name, np.zeros(FEATURES, np.int64))
                    grams[name] += np.bincount(feature, minlength=FEATURES)
                    scripts.update({(name, int(s)): int(n) for s, n in enumerate(np.bincount(script, minlength=len(SCRIPTS))) if n})
        for name, n in grams.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "feature", "n"])
        if scripts:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in scripts]), pa.array([-1 - k[1] for k in scripts], pa.int32()), pa.array([*scripts.values()], pa.int64())], names=["lang", "feature", "n"])

    known = rows.filter(F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    counted = known.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted["lang"].to_pylist()))
    index = {name: i for i, name in enumerate(langs)}
    column = np.array([index[x] for x in counted["lang"].to_pylist()], np.int64)
    feature, n = counted["feature"].to_numpy(), counted["n"].to_numpy()
    grams = np.zeros((FEATURES, len(langs)))
    scripts = np.zeros((len(SCRIPTS), len(langs)))
    own = feature >= 0
    grams[feature[own], column[own]] = n[own]
    scripts[-1 - feature[~own], column[~own]] = n[~own]
    logp = np.log((grams + smoothing) / (grams.sum(axis=0) + smoothing * FEATURES))
    letters = scripts.copy()
    letters[_NONE] = 0
    candidate = letters >= SCRIPT_SHARE * np.maximum(1, letters.sum(axis=0))
    candidate[~candidate.any(axis=1)] = True  # a script that was never seen narrows nothing
    return Model(langs, logp.astype(np.float32), candidate)


def _emissions(words: Words, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[word, language] scores, whether a word has a letter, and [word, language] whether
    its trigrams are likelier in the language than if all were equally likely."""
    script, feature, first = _byte_features(words)
    if not len(first):
        return np.zeros((0, len(model.langs)), np.float32), np.zeros(0, bool), np.zeros((0, len(model.langs)), bool)
    scores = np.add.reduceat(model.logp[feature], first, axis=0)
    known = scores > -np.log(FEATURES) * words.length[:, None]
    scores -= scores.max(axis=1, keepdims=True)
    scores = np.where(model.candidate[script], scores, -100.0).astype(np.float32)
    lettered = script != _NONE
    scores[~lettered] = 0
    return scores, lettered, known


def viterbi(scores: np.ndarray, per_doc: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; all texts advance by a word in step."""
    n, k = scores.shape
    best = np.zeros(n, np.int16)
    if not n:
        return best
    order = np.argsort(-per_doc, kind="stable")
    counts = per_doc[order]
    start = (np.cumsum(per_doc) - per_doc)[order]
    active = np.searchsorted(-counts, -np.arange(int(counts[0])), side="left")
    jumped = np.zeros((n, k), bool)
    origin = np.zeros(n, np.int16)
    v = scores[start[: active[0]]].copy()
    rows = np.arange(len(v))
    for t, m in enumerate(active[1:].tolist(), 1):
        at, own = start[:m] + t, v[:m]
        top = own.argmax(axis=1)
        jump = (own[rows[:m], top] - switch)[:, None]
        origin[at], jumped[at] = top, jump > own
        v[:m] = np.maximum(own, jump) + scores[at]
    now = v.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = start[:m] + t
        best[at] = now[:m]
        now[:m] = np.where(jumped[at, now[:m]], origin[at], now[:m])
    return best


_SPAN = pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])


def _label(texts: pa.Array, model: Model, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
    """Language, score, share of words that their language explains, and spans of each text of an array."""
    langs = np.array([*model.langs, UNKNOWN], object)
    width = max(1, len(model.langs))
    words = words_of_texts(texts)
    has_letter = np.array([bool(t) and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
    per_doc = words.per_doc()
    if model.langs:
        scores, lettered, known = _emissions(words, model)
        best = viterbi(scores, per_doc, switch).astype(np.int64)
        known = known[np.arange(len(best)), best] & lettered
    else:
        best, lettered = np.zeros(len(words.start), np.int64), np.zeros(len(words.start), bool)
        known = lettered
    weight = np.bincount(words.doc * width + best, lettered, len(texts) * width).reshape(-1, width)
    total = weight.sum(axis=1)
    und = ~has_letter | (not model.langs)
    pred = np.where(und, len(model.langs), weight.argmax(axis=1))
    score = np.where(und, 0.0, np.where(total > 0, weight.max(axis=1) / np.maximum(total, 1), 1 / width))
    explained = np.where(und, 0.0, np.bincount(words.doc, known, len(texts)) / np.maximum(total, 1))
    turn = np.diff(best) != 0
    turn |= np.diff(words.doc) != 0
    runs = np.flatnonzero(np.append(True, turn)) if len(best) else np.empty(0, np.int64)
    ends = np.append(runs[1:], len(best))[: len(runs)]
    kept = ~und[words.doc[runs]]
    runs, ends = runs[kept], ends[kept]
    owner = words.doc[runs]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
    first = np.cumsum(per_doc) - per_doc
    spans = pa.StructArray.from_arrays([pa.array(langs[best[runs]], pa.string()), pa.array(runs - first[owner]), pa.array(ends - runs)], fields=list(_SPAN))
    return langs[pred], score, explained, pa.ListArray.from_arrays(pa.array(bounds), spans)


def label(docs: DataFrame, model: Model, *, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of each row; spans are runs of words of one language.

    ``lang_pred`` has the most words with letters, ``score`` is their share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in slices(batch["text"], 8_000_000):
                lang, score, _, spans = _label(texts, model, switch)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, len(texts)), pa.array(lang, pa.string()), pa.array(score), spans], names=["doc_id", "lang_pred", "score", "spans"])

    schema = "doc_id long, lang_pred string, score double, spans array<struct<lang: string, first_word: long, n_words: long>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model, *, least: float = 0.5, switch: float = SWITCH) -> DataFrame:
    """``docs``, all columns, without texts that have no language, or whose words' languages explain less than ``least`` of them.

    The words of a mixed text may have several languages.  A word is explained if
    its trigrams are likelier in its language than if all trigrams were equally likely.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in slices(batch["text"], 8_000_000):
                lang, _, explained, _ = _label(texts.cast(pa.string()), model, switch)
                yield batch.slice(a, len(texts)).filter(pa.array((lang != UNKNOWN) & (explained >= least)))

    return docs.mapInArrow(run, docs.schema)
