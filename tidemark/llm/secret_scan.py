"""Secret scans: candidates by pattern, false positives removed by a random forest.

All of it is DataFrame operations and Spark ML (on the JVM).  A candidate is a run
of at least ``SHORTEST`` characters of the alphabets in which keys are written, or
any run without spaces behind a secret name and an assignment sign (in quotes up
to the closing one, else without closing punctuation).
Its features are its length, its character transitions, how much of it words of a
dictionary cover (the commonest words of all texts), whether it stands in a path or address, and the
words next to it.  The forest learns from labelled findings; where nobody has
labelled any, ``label_by_rules`` labels the clear cases (an assignment to a secret
name and a key with a known prefix are secrets; prose, repeated characters, UUIDs,
dates and hashes in paths are none), and the forest decides on all.  Its features
``named`` and ``assigned`` repeat a part of that rule.

Fitting takes a bounded sample: ``train_rows`` labelled findings of each label, in
the order of a hash.  Scanning takes every whole text.

Defined cases: null and empty texts have no findings; repeated rows and repeated
secrets are found once each; with fewer than two labels in the sample the rule's
label stands; ``redact`` keeps all columns and rows.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.llm.common import materialise

SHORTEST = 16
#: Names whose value is a secret (fixed values).
NAMES = "(?i)(token|secret|passwd|password|pwd|api_?key|access_?key|private_?key|auth|bearer|credential)"
#: Names of passwords, which people choose: short, and of any characters.
PASSWORDS = "(?i)(secret|passwd|password|pwd)"
#: What stands between a name and its value.
ASSIGN = "[\"'`]?\\s*[=:]\\s*[\"'`]?$"
_NAME = NAMES.replace("(?i)(", "(?i:")
#: Behind a name and an assignment sign; cheap looks back come first.
_BEHIND = f"(?<=[=:\\s\"'`])(?<=[=:]\\s{{0,4}}[\"'`]?)(?<={_NAME}[\"'`]?\\s{{0,4}}[=:]\\s{{0,4}}[\"'`]?)(?![\"'`\\s])"
_VALUE = "(?:(?<=\")[^\\s\"]+(?=\")|(?<=')[^\\s']+(?=')|(?<=`)[^\\s`]+(?=`)|\\S*[^\\s,;.)\\]}>\"'`])"
#: A run that starts with a secret name and an equals sign is no candidate as a whole, its value is one.
_NOT_NAME = f"(?![A-Za-z0-9+/_\\-]*+=(?<={_NAME}=)[^\\s=])"
CANDIDATE = f"{_BEHIND}{_VALUE}|{_NOT_NAME}[A-Za-z0-9+/_=\\-]{{{SHORTEST},}}"
#: Keys that show by their prefix what they are, UUIDs, dates, and hashes.
PREFIXED = "^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}|^glpat-[A-Za-z0-9_-]{20}|^xox[abprs]-[A-Za-z0-9-]{10}|^sk_(live|test)_[A-Za-z0-9]{16}|^AIza[A-Za-z0-9_-]{35}$"
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
DATED = "(^|[^0-9])(19|20)[0-9]{2}[-/_](0[1-9]|1[0-2])[-/_]([0-2][0-9]|3[01])([^0-9]|$)"
HASH = "(?i)(^|/)([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
#: The commonest pairs of letters of running text; few of them stand in a key.
COMMON_PAIRS = "th|he|in|er|an|re|on|en|at|nd|st|es|ti|or|te|ed|is|it|al|ar|ou|le|de|io|ch|ei|qu|ai|eu|la|ue|os"
FEATURES = ["length", "digits", "uppers", "symbols", "turns", "repeats", "distinct", "covered", "pairs", "in_path", "source_is_path", "named", "quoted", "assigned", "prose_before", "prose_after"]
REPLACEMENT = "[secret]"
#: Words of the dictionary, learned from the texts.
DICTIONARY_WORDS = 5000


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, source, ordinal, start, value, before, after) of every candidate of every text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), text.alias("text")).filter(F.col("text").rlike(CANDIDATE))
    found = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    parts = own.select("doc_id", "source", F.monotonically_increasing_id().alias("row"), found.alias("values"), F.split("text", CANDIDATE, -1).alias("gaps"))
    # of the text between candidates only its ends go on, and its length
    near = F.transform("gaps", lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(40)).alias("end"), F.left(g, F.lit(24)).alias("begin")))
    parts = parts.withColumn("gaps", near)
    each = parts.select(
        "doc_id",
        "source",
        "row",
        F.posexplode(F.arrays_zip(F.col("values").alias("value"), F.col("gaps").alias("before"), F.slice("gaps", 2, F.size("gaps")).alias("after"))).alias("ordinal", "at"),
    ).filter(F.col("at.value").isNotNull())
    order = W.Window.partitionBy("row").orderBy("ordinal").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    start = F.sum(F.col("at.before.n") + F.length("at.value")).over(order) - F.length("at.value")
    return each.select("doc_id", "source", "ordinal", start.alias("start"), "at.value", F.col("at.before.end").alias("before"), F.coalesce("at.after.begin", F.lit("")).alias("after"))


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def dictionary(docs: DataFrame, size: int = DICTIONARY_WORDS) -> DataFrame:
    """(word, length): the ``size`` commonest words of three to twenty letters a-z of all texts, ties to the smaller word.

    A key that is repeated thousands of times isn't made of letters alone.
    """
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), "[^\\p{L}\\p{N}_]+")).alias("word"))
    counted = words.filter(F.length("word").between(3, 20) & ~F.col("word").rlike("[^a-z]")).groupBy("word").count()
    return counted.orderBy(F.desc("count"), "word").limit(size).select("word", F.length("word").alias("length"))


def _covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """(key, letters): how many letters of each candidate stand in words of the dictionary (which is of bounded size)."""
    parts = F.regexp_extract_all(F.regexp_replace("value", "([a-z])([A-Z])", "$1 $2"), F.lit("([A-Za-z]{3,})"), F.lit(1))
    runs = found.select("key", F.explode(parts).alias("word")).withColumn("word", F.lower("word"))
    return runs.join(F.broadcast(words), "word").groupBy("key").agg(F.sum("length").alias("letters"))


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Add the features of each candidate as doubles."""
    if "source" not in found.columns:
        found = found.withColumn("source", F.lit(None).cast("string"))
    found = found.withColumn("key", F.xxhash64(*[c for c in ("doc_id", "ordinal", "value", "before", "after") if c in found.columns]))
    found = found.join(_covered(found.dropDuplicates(["key"]), words), "key", "left")
    letters = F.split("value", "")
    value = {
        "length": F.log2(F.length("value")),
        "digits": _share("[0-9]"),
        "uppers": _share("[A-Z]"),
        "symbols": _share("[+/_=-]"),
        "turns": _share("(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])|(?<=[0-9])(?![0-9])"),
        "repeats": _share("(.)(?=\\1)"),
        "distinct": F.size(F.array_distinct(letters)) / F.length("value"),
        "covered": F.coalesce("letters", F.lit(0)) / F.length("value"),
        "pairs": _share(f"(?i)({COMMON_PAIRS})"),
        "in_path": F.col("before").rlike("(://|[./@\\\\])\\S*$") | F.col("value").rlike("/.*/"),
        "source_is_path": F.coalesce(F.col("source").rlike("[./\\\\]"), F.lit(False)),
        "named": F.col("before").rlike(NAMES + "\\W*$"),
        "quoted": F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]"),
        "assigned": F.col("before").rlike("[=:]\\s*[\"'`]?$"),
        "prose_before": F.col("before").rlike("\\p{L}[,.]?\\s+$"),
        "prose_after": F.col("after").rlike("^[,.]?\\s+\\p{L}"),
    }
    return found.withColumns({name: col.cast("double") for name, col in value.items()}).drop("key", "letters")


def label_by_rules(found: DataFrame) -> DataFrame:
    """Add ``label``: 1.0 for clear secrets, 0.0 for clear false positives, else null."""
    value, before = F.col("value"), F.col("before")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    distinct = F.size(F.array_distinct(F.split("value", "")))
    named = before.rlike(NAMES + ASSIGN)
    chosen = before.rlike(PASSWORDS + ASSIGN) & (distinct >= 5)
    prefixed = value.rlike(PREFIXED)
    secret = prefixed | named & mixed & ((distinct >= 8) | chosen)
    in_path = before.rlike("[./@\\\\]\\S*$") | value.rlike("/.*/")
    unnamed = ~named & ~prefixed & (value.rlike(UUID) | value.rlike(DATED) | (value.rlike(HASH) & in_path))
    quoted_name = named & before.rlike("[\"'`]$")
    plain = ~value.rlike("[0-9]") & ~quoted_name | value.rlike("^(.{1,4})\\1{3,}") | value.rlike("(?i)example|placeholder|x{6}|your_") | unnamed
    return found.withColumn("label", F.when(plain, 0.0).when(secret, 1.0))


def train(findings: DataFrame, *, train_rows: int = 4000, trees: int = 20, depth: int = 6, seed: int = 7):
    """A forest for labelled findings with features, or None where a label is missing."""
    spread = F.xxhash64("value", "before", "after", F.lit(seed))
    sample = None
    for label in (0.0, 1.0):
        part = findings.filter(F.col("label") == label).select(*FEATURES, "label", spread.alias("spread")).orderBy("spread").limit(train_rows)
        if part.isEmpty():
            return None
        sample = part if sample is None else sample.unionAll(part)
    steps = [VectorAssembler(inputCols=FEATURES, outputCol="features"), RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=steps).fit(sample.coalesce(1))


def scan(docs: DataFrame, findings: DataFrame | None = None, *, threshold: float = 0.5, dictionary_words: int = DICTIONARY_WORDS, holders: DataFrame | None = None, **options) -> DataFrame:
    """Every candidate with its ``score`` and whether it ``is_secret``.

    ``findings``: labelled ones (columns of ``candidates`` and ``label``); without
    them, the clear cases among the candidates of ``docs`` are taken.  ``holders``:
    the rows of ``docs`` that hold candidates, if they are known already.
    """
    found = materialise(candidates(docs if holders is None else holders), "secret-candidates")
    words = materialise(dictionary(docs, dictionary_words), "secret-dictionary")
    found = materialise(with_features(found, words), "secret-features")
    labelled = with_features(findings, words) if findings is not None else label_by_rules(found)
    model = train(labelled, **options)
    keep = ["doc_id", "ordinal", "start", F.length("value").alias("n_chars"), "value", "before"]
    if model is None:
        scored = label_by_rules(found).select(*keep, F.coalesce("label", F.lit(0.0)).alias("score"))
    else:
        scored = model.transform(found).select(*keep, vector_to_array("probability")[1].alias("score"))
    return scored.withColumn("is_secret", F.col("score") >= threshold)


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every secret replaced where it stands, and ``n_chars`` (if there) counted anew.

    Rows are told apart by a number of their own, so rows with null or repeated ids keep their own texts.
    Within a row, a candidate that has a secret's value is replaced as well. All columns and rows stay.
    A group is as large as the findings of one text, and only texts that hold candidates are shuffled.
    """
    number, spans, holds = (next(c for c in map((name + "_{}").format, range(len(docs.columns) + 1)) if c not in docs.columns) for name in ("row_number", "spans", "holds"))
    candidate = F.coalesce(F.col("text").cast("string").rlike(CANDIDATE), F.lit(False))
    rows = materialise(docs.withColumns({number: F.monotonically_increasing_id(), holds: candidate}), "secret-rows")
    read = rows.select(F.col(number).alias("doc_id"), "text", holds, *(["source"] if "source" in docs.columns else []))
    found = scan(read.drop(holds), holders=read.filter(holds).drop(holds), **options)
    alike = found.groupBy("doc_id", "value").agg(F.max("is_secret").alias("is_secret"), F.collect_list(F.struct("start", "n_chars")).alias("at")).filter("is_secret")
    places = alike.groupBy(F.col("doc_id").alias(number)).agg(F.array_sort(F.flatten(F.collect_list("at"))).alias(spans))
    joined = rows.filter(holds).join(places, number, "left")
    n = F.size(spans)
    end = lambda i: F.when(i == 0, 0).otherwise(F.element_at(spans, F.greatest(i, F.lit(1))).start + F.element_at(spans, F.greatest(i, F.lit(1))).n_chars)
    kept = F.transform(F.sequence(F.lit(0), n), lambda i: F.col("text").substr((end(i) + 1).cast("int"), F.when(i < n, F.element_at(spans, F.least(i + 1, n)).start - end(i)).otherwise(F.length("text")).cast("int")))
    out = joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(kept, REPLACEMENT)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns).unionAll(rows.filter(~F.col(holds)).select(*docs.columns))
