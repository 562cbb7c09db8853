"""Claims of answers, the passages that support them, verified citations, and one-to-one assignments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.chunks import rows_of_texts
from tidemark.sources.tables import materialise

#: Citations, preambles and declarations that are no claims (fixed values).
CITATION = r"(?i)\[(?:ID:?\s*)?[a-zA-Z0-9_\-\.:]+\]|\(\d+\)"
PREAMBLES = (
    r"(?i)^(?:according to|based on|per|as stated in)\s+[^,.:;]+[,.:;]\s*",
    r"(?i)^(?:the\s+)?(?:provided\s+)?(?:evidence|circular|direction|document)s?\s+(?:states?|indicates?|shows?|mandates?)\s+that\s+",
    r"(?i)^(?:in summary|here is the summary|summary)[:\s]*",
)
FILLERS = ("insufficient evidence", "cannot be answered", "not provided in the", "does not contain")
#: Characters of a claim at least, and from which on it is cut at what joins its parts (fixed values).
SHORTEST, LONG = 12, 120
#: Numbers with units, words that negate, and bounds whose "not" doesn't (fixed values).
NUMBER = r"(?i)\b(?:\d+(?:\.\d+)?%|\d+\s*(?:percent|basis points|bps|days|months|years|hours|weeks|crore|lakh|lakhs)|rs\.?\s*\d+(?:\.\d+)?)\b"
NEGATIONS = {"not", "never", "no", "prohibited", "forbidden", "disallowed", "exempt", "waived"}
BOUND = r"\bnot\s+(?:be\s+)?(?:less\s+than|fewer\s+than|more\s+than|greater\s+than|exceeding|exceed|later\s+than|earlier\s+than|below|above)\b"
STOPWORDS = set("a an the and or of to in is are was were for with by at from as on that this it its be shall must should may can will would".split())
#: Names of supervised entities, by what they stand for (fixed values).
ENTITIES = {
    "urban_cooperative_bank": ("primary urban co-operative bank", "primary urban co-operative banks", "urban co-operative bank", "urban co-operative banks"),
    "scheduled_commercial_bank": ("scheduled commercial bank", "scheduled commercial banks"),
    "small_finance_bank": ("small finance bank", "small finance banks"),
    "payments_bank": ("payments bank", "payments banks"),
    "housing_finance_company": ("housing finance company", "housing finance companies"),
    "asset_reconstruction_company": ("asset reconstruction company", "asset reconstruction companies"),
    "core_investment_company": ("core investment company", "core investment companies"),
    "payment_aggregator": ("payment aggregator", "payment aggregators"),
    "payment_gateway": ("payment gateway", "payment gateways"),
    "ppi": ("prepaid payment instruments", "prepaid payment instrument", "ppi"),
    "foreign_bank": ("foreign bank", "foreign banks"),
    "nbfc": ("non-banking financial company", "non-banking financial companies", "non-banking financial", "nbfc", "nbfcs"),
    "nbfc_mfi": ("nbfc-mfi",),
    "nbfc_icc": ("nbfc-icc",),
    "regional_rural_bank": ("regional rural bank", "regional rural banks"),
    "credit_information_company": ("credit information company", "credit information companies"),
    "commercial_bank": ("commercial bank", "commercial banks"),
}
#: Reasons of an answer's generation to end that make it whole (fixed values).
WHOLE = ("stop", "end_turn", "completed")
TAG = r"\[([a-zA-Z0-9_\-]+)\]"


def claims_of(answer: str) -> Iterator[str]:
    """The statements of an answer, without citations, marks of lists and preambles."""
    bare = re.sub(CITATION, "", answer).replace("**", "").replace("__", "")
    for unit in re.split(r"(?<=[.!?;\n])\s+", bare):
        text = re.sub(r"^(?:[-*•]|\d+\.)\s*", "", unit.strip()).strip()
        for form in PREAMBLES:
            text = re.sub(form, "", text).strip()
        if len(text) < SHORTEST or any(f in text.lower() for f in FILLERS):
            continue
        joined = len(text) > LONG and any(j in text for j in ("; ", ", and ", " and furthermore "))
        parts = re.split(r";\s*|,\s*and\s+|\s+and furthermore\s+", text) if joined else [text]
        yield from (p.strip() for p in parts if len(p.strip()) >= SHORTEST)


def _stem(word: str) -> str:
    n = len(word)
    endings = (("ies", n > 4, "y"), ("es", n > 4, ""), ("s", n > 3 and not word.endswith("ss"), ""), ("ing", n > 5, ""), ("ed", n > 4, ""))
    if n > 3:
        for ending, long, instead in endings:
            if long and word.endswith(ending):
                return word.removesuffix(ending) + instead
    return word


def _number(raw: str) -> str:
    raw = re.sub(r"^rs\.?", "rs", re.sub(r"\s+", "", raw.lower()))
    return re.sub(r"\.0+%", "%", re.sub(r"(\d+(?:\.\d+)?)(?:percent|pct|%)", r"\1%", raw))


@dataclass(frozen=True)
class Statement:
    """What counts of a text when it supports, or is supported."""

    low: str
    numbers: frozenset
    negated: bool
    entities: frozenset
    words: frozenset

    @classmethod
    def of(cls, text: str) -> Statement:
        low = text.lower()
        plain = set(re.findall(r"\b[a-zA-Z]+\b", re.sub(BOUND, " ", low)))
        words = frozenset(_stem(w) for w in re.findall(r"\b[a-zA-Z0-9-]+\b", low) if w not in STOPWORDS and len(w) > 1)
        named = frozenset(e for e, names in ENTITIES.items() if any(n in low for n in names))
        return cls(low, frozenset(_number(m) for m in re.findall(NUMBER, text)), bool(plain & NEGATIONS), named, words)


def support(claim: Statement, passage: Statement) -> tuple[float, str]:
    """(0 to 1, why): how far a passage says what a claim says."""
    if claim.low in passage.low:
        return 1.0, "exact_substring"
    if not claim.numbers <= passage.numbers:
        return 0.10, "numerical_conflict_missing"
    shared = claim.words & passage.words
    if claim.negated != passage.negated and len(shared) >= 3:
        return 0.05, "negation_polarity_inversion"
    if not claim.entities <= passage.entities:
        return 0.20, "unsupported_entity_introduced"
    if not claim.words:
        return 0.50, "empty_claim_tokens"
    score = len(shared) / len(claim.words)
    for held, more in ((claim.numbers, 0.25), (claim.entities, 0.20)):
        score = min(1.0, score + more) if held else score
    return score, "token_semantic_overlap"


def _supports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Statement] = {}
    for batch in batches:
        out = []
        for claim, passage in zip(batch.column("claim").to_pylist(), batch.column("passage").to_pylist(), strict=True):
            if len(known) > 2_000:
                known.clear()
            for text in (claim, passage):
                if text not in known:
                    known[text] = Statement.of(text)
            out.append(support(known[claim], known[passage]))
        kept = batch.drop_columns(["claim", "passage"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([s for s, _ in out], pa.float64()), pa.array([r for _, r in out], pa.string())], [*kept.schema.names, "score", "reason"])


def supported_claims(answers: DataFrame, passages: DataFrame, *, threshold: float = 0.65) -> DataFrame:
    """(answer_id, ordinal, claim, score, passage_id, reason, supported): each claim with the first of its best passages.

    ``answers`` (answer_id, text), ids unique; ``passages`` (answer_id, place, passage_id, text) are those of each answer, in the
    order of their place. A claim meets the passages of its own answer only. Null texts make no claims and support nothing.
    """
    claims = materialise(rows_of_texts(answers.select("answer_id", "text"), lambda t: enumerate(claims_of(t)), "ordinal int, claim string"), "claims")
    pairs = claims.join(passages.filter("text is not null").select("answer_id", "place", "passage_id", F.col("text").alias("passage")), "answer_id")
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("answer_id", "place", "passage_id")}
    scored = pairs.select("answer_id", "ordinal", "place", "passage_id", "claim", "passage").mapInArrow(
        _supports, f"answer_id {kinds['answer_id']}, ordinal int, place {kinds['place']}, passage_id {kinds['passage_id']}, score double, reason string"
    )
    best = scored.filter("score > 0").groupBy("answer_id", "ordinal").agg(F.min(F.struct((-F.col("score")).alias("minus"), "place", "passage_id", "reason")).alias("best"))
    score = F.coalesce(-F.col("best.minus"), F.lit(0.0))
    found = claims.join(best, ["answer_id", "ordinal"], "left")
    return found.select("answer_id", "ordinal", "claim", F.round(score, 4).alias("score"), "best.passage_id", "best.reason", (score >= threshold).alias("supported"))


def faithfulness(answers: DataFrame, claims: DataFrame, *, least: float = 0.98) -> DataFrame:
    """(answer_id, score, total, supported, faithful): the share of an answer's claims that are supported; 1 without claims."""
    counted = claims.groupBy("answer_id").agg(F.count("*").alias("total"), F.count_if("supported").alias("supported"))
    found = answers.select("answer_id").join(counted, "answer_id", "left").fillna(0, ["total", "supported"])
    share = F.when(F.col("total") == 0, 1.0).otherwise(F.col("supported") / F.col("total"))
    return found.select("answer_id", F.round(share, 4).alias("score"), "total", "supported", (share >= least).alias("faithful"))


def attribution(answers: DataFrame, passages: DataFrame, quotes: DataFrame) -> DataFrame:
    """(answer_id, state): grounded, or the first thing that is wrong with an answer's citations.

    ``answers`` (answer_id, text, finish_reason, abstained, citations), ``passages`` (answer_id, passage_id, text), ``quotes``
    (answer_id, passage_id, quote). truncated: it didn't end by itself; abstained; uncited: no citation in the list or the
    text; fabricated: one of them, or a quote's, is no passage of the answer; misquoted: a quote isn't in its passage.
    """
    tags = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TAG), F.lit(1))
    cited = F.array_distinct(F.concat(F.coalesce("citations", F.array().cast("array<string>")), tags))
    own = materialise(answers.select("answer_id", "finish_reason", F.coalesce("abstained", F.lit(False)).alias("abstained"), cited.alias("cited")), "claims-answers")
    there = passages.select("answer_id", F.col("passage_id").alias("cite"), F.coalesce("text", F.lit("")).alias("said")).dropDuplicates(["answer_id", "cite"])
    asked = own.select("answer_id", F.explode("cited").alias("cite"), F.lit(None).cast("string").alias("quote")).unionAll(quotes.select("answer_id", "passage_id", "quote"))
    met = asked.join(there, ["answer_id", "cite"], "left")
    wrong = met.groupBy("answer_id").agg(F.bool_or(F.col("said").isNull()).alias("unknown"), F.bool_or(F.coalesce(~F.contains("said", "quote"), F.lit(False))).alias("misquoted"))
    found = own.join(wrong, "answer_id", "left")
    whole = F.coalesce(F.col("finish_reason").isin(*WHOLE), F.lit(False))
    state = F.when(~whole, "truncated").when(F.col("abstained"), "abstained").when(F.size("cited") == 0, "uncited").when(F.col("unknown"), "fabricated").when(F.col("misquoted"), "misquoted").otherwise("grounded")
    return found.select("answer_id", state.alias("state"))


def assigned(scores: DataFrame, *, most_rounds: int = 1000) -> DataFrame:
    """(left, right, score): a one-to-one assignment, the same that takes pairs by falling score (ties by left, then right).

    ``scores`` (left, right, score), scores above 0. In each round all pairs that are the best of both their sides are taken,
    so independent groups are done at the same time; whatever pair is missed shares a side with a better one, so the sum is
    at least half of the largest possible one. Of repeated pairs the best counts.
    """
    open_ = materialise(scores.filter("score > 0 and left is not null and right is not null").groupBy("left", "right").agg(F.max("score").alias("score")), "assigned-open")
    taken = open_.limit(0)
    for _ in range(most_rounds):
        if open_.isEmpty():
            return taken
        order = F.struct((-F.col("score")).alias("minus"), "left", "right")
        best = open_.groupBy(F.col("left").alias("l")).agg(F.min(order).alias("best"))
        other = open_.groupBy(F.col("right").alias("r")).agg(F.min(order).alias("best"))
        now = materialise(best.join(other, ["best"]).select("best.left", "best.right", (-F.col("best.minus")).alias("score")), "assigned-round")
        taken = taken.unionAll(now)
        open_ = materialise(open_.join(now.select("left"), "left", "left_anti").join(now.select("right"), "right", "left_anti").select("left", "right", "score"), "assigned-open")
    raise RuntimeError(f"not done after {most_rounds} rounds")
