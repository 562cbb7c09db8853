"""License scans by diagonal voting, in DataFrame operations only.

The word 3-grams of every text that any template has are joined, by their hash,
to the positions that they have in the license templates (a fixed table, so it is
broadcast); templates too short to keep a 3-gram when a word is changed are also
found by their pairs of words.  Hits are added up by diagonal (word position minus
template position), diagonals at most ``slip`` apart are merged, and a merged span
counts if ``coverage`` of the template's words stand in it in their order, the
words that name a license and its version (``NAMING``) among them.  Base phrases
need all of their grams on one diagonal.

Defined cases: a null or empty text has no words and no labels; repeated rows get
the same values; a null ``doc_id`` is kept; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

GRAM = 3
NOT_A_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Base phrases and their labels (fixed values).
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Sentences of licenses and grants, and the label that each gives.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "mozilla public license version 2 0": "mpl-2",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
}

#: Words that tell a license from others; a span without one of its template's isn't that license.
NAMING = {"apache", "noncommercial", "gnu", "lesser", "mozilla", "2", "3"}


def words_of(text: Column) -> Column:
    """Words of a text lower-cased in A-Z.

    ``lower`` also changes letters outside ASCII, which doesn't matter to ASCII
    templates but for the Kelvin sign, whose lower case is an ASCII letter.
    """
    kept = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ufffd"))
    return F.filter(F.split(F.lower(kept), NOT_A_WORD), lambda w: w != "")


def _grams(phrase: str, base: bool) -> list[tuple[int, str]]:
    """(position, gram) of a phrase: 3-grams, and pairs if a changed word may leave no 3-gram."""
    words = phrase.split()
    sizes = (GRAM,) if base or len(words) >= 2 * GRAM else (GRAM, GRAM - 1)
    return [(i, " ".join(words[i : i + size])) for size in sizes for i in range(len(words) - size + 1)]


def template_grams(spark) -> DataFrame:
    """(template, label, base, n_grams, at, gram): each gram of each template at its position."""
    rows = []
    for base, phrases in ((True, BASE), (False, TEMPLATES)):
        for phrase, label in phrases.items():
            rows += [(phrase, label, base, len(phrase.split()) - GRAM + 1, at, gram) for at, gram in _grams(phrase, base)]
    return spark.createDataFrame(rows, "template string, label string, base boolean, n_grams int, at int, gram string")


def _matched(template: Column, window: Column) -> tuple[Column, Column]:
    """How many words of the template stand in the window in their order, and how many of those in NAMING.

    The longest common subsequence, by a row of it for each word of the window;
    a word in NAMING weighs more than all others together, so that none is given up.
    """
    words = F.split(template, " ")
    heavy = 1000
    weight = F.transform(words, lambda w: F.when(w.isin(*sorted(NAMING)), F.lit(heavy + 1)).otherwise(F.lit(1)))

    def row(best: Column, word: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.size(words) - 1),
            F.array(F.lit(0)),
            lambda own, j: F.concat(own, F.array(F.greatest(F.get(best, j + 1), F.get(own, j), F.when(F.get(words, j) == word, F.get(best, j) + F.get(weight, j)).otherwise(F.lit(0))))),
        )

    total = F.element_at(F.aggregate(window, F.array_repeat(F.lit(0), F.size(words) + 1), row), -1)
    return total % heavy, F.floor(total / heavy)


def find(docs: DataFrame, *, slip: int = 2, coverage: float = 0.7) -> DataFrame:
    """The verified spans: (doc_id, text_hash, template, label, base, start, n_words, score)."""
    templates = F.broadcast(template_grams(docs.sparkSession).withColumn("hash", F.xxhash64("gram")))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    longest = max(len(phrase.split()) for phrase in TEMPLATES)
    places = F.sequence(F.lit(0), F.size("words") - 2)

    def found(size: int) -> Column:
        # at the end of a text a 3-gram has two words: it is the pair there, or no gram of any template
        known = sorted({gram for base, phrases in ((True, BASE), (False, TEMPLATES)) for phrase in phrases for _, gram in _grams(phrase, base) if len(gram.split()) == size})
        own = F.transform(places, lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", *(F.get("words", i + j) for j in range(size))).alias("found")))
        return F.filter(own, lambda g: g["found"].isin(known))

    # a hit takes along the words around it, as far as a template at its place may reach
    reach = longest + slip
    around = F.transform(
        F.concat(found(GRAM), found(GRAM - 1)),
        lambda g: F.struct(g["pos"].alias("pos"), g["found"].alias("found"), F.slice("words", F.greatest(g["pos"] - reach, F.lit(0)) + 1, F.lit(2 * reach)).alias("around")),
    )
    every = words.filter(F.size("words") >= 2).select("doc_id", "text_hash", F.inline(around))
    every = every.withColumn("found_hash", F.xxhash64("found"))
    hits = every.join(templates, (F.col("found_hash") == F.col("hash")) & (F.col("found") == F.col("gram")))
    diagonal = F.col("pos") - F.col("at")
    from_word = F.greatest(diagonal - slip, F.lit(0))
    to_word = diagonal + F.size(F.split("template", " ")) + slip
    window = F.slice("around", from_word - F.greatest(F.col("pos") - reach, F.lit(0)) + 1, to_word - from_word)
    last = F.col("pos") + F.size(F.split("found", " "))
    hits = hits.select("doc_id", "text_hash", "template", "label", "base", "n_grams", diagonal.alias("diagonal"), "at", "pos", last.alias("last"), F.when(~F.col("base"), window).alias("window"))

    key = ["doc_id", "text_hash", "template", "label", "base", "n_grams"]
    voted = hits.groupBy(*key, "diagonal").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("last").alias("last"), F.any_value("window").alias("window"))
    matched, naming = _matched(F.col("template"), F.col("window"))
    voted = voted.withColumns({"matched": matched, "naming": naming})
    order = W.Window.partitionBy(*key).orderBy("diagonal")
    apart = F.when(F.col("base"), F.lit(0)).otherwise(F.lit(slip))
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > apart, F.lit(True))
    best = F.max(F.struct("naming", "matched"))
    merged = (
        voted.withColumn("island", F.sum(new.cast("int")).over(order))
        .groupBy(*key, "island")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("seen"), F.min("first").alias("start"), F.max("last").alias("end"), best.alias("best"))
    )
    of_template = F.split("template", " ")
    names = F.size(F.filter(of_template, lambda w: w.isin(*sorted(NAMING))))
    score = F.when(F.col("base"), F.col("seen") / F.col("n_grams")).otherwise(F.col("best.matched") / F.size(of_template))
    whole = F.col("base") & (F.col("seen") == F.col("n_grams"))
    near = ~F.col("base") & (score >= coverage) & (F.col("best.naming") == names)
    return merged.filter(whole | near).select(
        "doc_id", "text_hash", "template", "label", "base", F.col("start").cast("long").alias("start"), (F.col("end") - F.col("start")).cast("long").alias("n_words"), score.cast("double").alias("score")
    )


def scan(docs: DataFrame, **options) -> DataFrame:
    """One row per document with its base places, labels and best score."""
    base = F.col("base")
    spans = find(docs, **options).groupBy("doc_id", "text_hash").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    spans = spans.withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = own.join(spans, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
