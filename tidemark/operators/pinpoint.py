"""Where in a document a query is answered: sentences by score, and the least window that holds the query's terms."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.operators.folds import fold_sorted
from tidemark.operators.scans import STOPWORDS, terms
from tidemark.operators.sentences import sentence_spans
from tidemark.sources.tables import materialise

#: What a query asks for by its words, and what a sentence then should hold (fixed values).
INTENTS = (
    (("rate", "interest", "percent", "percentage", "crar"), ("%", "percent", "rate of interest", "crar")),
    (("amount", "loan", "worth", "capital", "finance"), ("₹", "rs", "crore", "lakh", "finance up to", "net worth")),
    (("deadline", "time", "hours", "days", "report"), ("within", "hours", "days")),
    (("layers", "four", "tier", "levels"), ("layers", "four", "base layer")),
)
#: Shares of coverage, of a phrase, of intents (each, and together at most) and of two terms in a score (fixed values).
COVERAGE, PHRASE, INTENT, MOST_INTENT, TWO_TERMS = 0.40, 0.25, 0.20, 0.35, 0.15


def _holds_any(text: Column, parts: tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def query_features(text: Column) -> Column:
    """A query's terms, pairs of neighbouring words, and intents, worked out once for all of its sentences."""
    low = F.lower(text)
    words = F.filter(F.split(low, r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w, i: F.concat_ws(" ", F.get(words, i), w))
    return F.struct(F.array_distinct(terms(text)).alias("terms"), pairs.alias("pairs"), F.array(*(_holds_any(low, asked) for asked, _ in INTENTS)).alias("intents"))


def sentence_score(features: Column, sentence: Column) -> Column:
    """0 to 1: coverage of the query's terms, a phrase of it, what it asks for, and at least two terms."""
    low, own = F.lower(sentence), F.array_distinct(terms(sentence))
    matched = F.size(F.array_intersect(features["terms"], own))
    phrase = F.exists(features["pairs"], lambda p: F.contains(low, p))
    bonus = functools.reduce(lambda a, b: a + b, (F.when(features["intents"][i] & _holds_any(low, said), INTENT).otherwise(0.0) for i, (_, said) in enumerate(INTENTS)))
    raw = COVERAGE * matched / F.size(features["terms"]) + F.when(phrase, PHRASE).otherwise(0.0) + F.least(F.lit(MOST_INTENT), bonus) + TWO_TERMS * F.least(F.lit(1.0), matched / 2.0)
    return F.when((F.size(features["terms"]) == 0) | (F.size(own) == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def pinpoint(pairs: DataFrame, items: DataFrame, docs: DataFrame, *, least: float = 0.6, most: int = 2) -> DataFrame:
    """(item_id, doc_id, start, end, score) of the ``most`` best sentences of each pair with at least ``least``, ties to the earlier.

    ``pairs`` (item_id, doc_id) say which documents are looked at for which query. Each document is cut into sentences once.
    Null and blank texts and queries have none.
    """
    wanted = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    spans = materialise(sentence_spans(wanted), "pinpoint-sentences")
    asked = items.select("item_id", query_features(F.col("text")).alias("features"))
    scored = pairs.select("item_id", "doc_id").distinct().join(asked, "item_id").join(spans, "doc_id").select("item_id", "doc_id", "start", "end", sentence_score(F.col("features"), F.col("sentence")).alias("raw"))
    place = F.row_number().over(W.Window.partitionBy("item_id", "doc_id").orderBy(F.desc("raw"), "start"))
    return scored.filter(F.col("raw") >= least).withColumn("place", place).filter(F.col("place") <= most).select("item_id", "doc_id", "start", "end", F.round("raw", 4).alias("score"))


def cover_windows(pairs: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, n_terms, first, last): the shortest run of a document's terms that holds all of the query's terms it has.

    Places count the terms of the text from 0; of equally short runs the first is taken. The occurrences of a pair are read
    in their order, and only the last place of each term is kept. Pairs that share no term have no row.
    """
    wanted = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", terms(F.col("text")).alias("t"))
    places = wanted.select("doc_id", F.posexplode("t").alias("place", "term"))
    asked = pairs.select("item_id", "doc_id").distinct().join(items.select("item_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")), "item_id")
    met = materialise(asked.join(places, ["doc_id", "term"]).withColumn("pair", F.concat_ws(":", F.col("item_id").cast("string"), F.col("doc_id").cast("string"))), "pinpoint-places")

    def step(last: dict, row: dict) -> tuple:
        last.pop(row["term"], None)
        last[row["term"]] = row["place"]  # the oldest place stands first
        return row["item_id"], row["doc_id"], len(last), next(iter(last.values())), row["place"]

    kinds = {c: met.schema[c].dataType.simpleString() for c in ("item_id", "doc_id")}
    runs = fold_sorted(met, "pair", ["place"], dict, step, f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}, n_terms int, first int, last int")
    best = F.min(F.struct((-F.col("n_terms")).alias("n"), (F.col("last") - F.col("first")).alias("size"), "first", "last")).alias("best")
    return runs.groupBy("item_id", "doc_id").agg(best).select("item_id", "doc_id", (-F.col("best.n")).alias("n_terms"), "best.first", "best.last")
