"""Registered queries of claims and citations, with their SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import claims, constraints, drift
from tidemark.plans.catalogue import query
from tidemark.sources.tables import table


@query()
def answer_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn against all other turns of its conversation (tests hold it against a plain version)."""
    turns = table(spark, sf_dir, "conversations").withColumn("answer_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    answers = turns.filter("role = 'assistant'").dropDuplicates(["answer_id"])
    others = turns.select("conv_id", F.col("turn").alias("place"), F.col("answer_id").alias("passage_id"), "text")
    passages = answers.select("answer_id", "conv_id").join(others, "conv_id").filter("answer_id <> passage_id").select("answer_id", "place", "passage_id", "text")
    return claims.faithfulness(answers, claims.supported_claims(answers, passages))


@query("""
select o_orderkey as answer_id, case when o_orderkey % 11 = 0 then 'truncated' when o_orderkey % 13 = 0 then 'abstained' when o_orderkey % 7 = 0 then 'uncited' when o_orderkey % 5 = 0 then 'fabricated' when o_orderkey % 3 = 0 then 'misquoted' else 'grounded' end as state from orders""")
def attribution_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each order that cites its lines' suppliers and quotes the status; some break off, abstain, cite nothing or what isn't there, or misquote."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    tag = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("["), F.when(k % 5 == 0, "nowhere").otherwise("p1"), F.lit("]")))
    answers = orders.select(k.alias("answer_id"), F.concat(F.lit("It is so. "), tag).alias("text"), F.when(k % 11 == 0, "length").otherwise("stop").alias("finish_reason"), (k % 13 == 0).alias("abstained"), F.array().cast("array<string>").alias("citations"))
    passages = orders.select(k.alias("answer_id"), F.lit("p1").alias("passage_id"), F.concat(F.lit("Status "), "o_orderstatus", F.lit(" of "), "o_orderpriority").alias("text"))
    quotes = orders.filter(k % 7 != 0).select(k.alias("answer_id"), F.lit("p1").alias("passage_id"), F.when(k % 3 == 0, "no such words").otherwise(F.concat(F.lit("Status "), "o_orderstatus")).alias("quote"))
    return claims.attribution(answers, passages, quotes)


@query("""
with i as (select doc_id as item_id, doc_id % 10 = 3 as o, doc_id from documents),
p as (
  select item_id, unnest(list_filter([
    if(doc_id % 17 = 2, 'unknown answer_type', null), if(doc_id % 19 = 0, 'unknown difficulty', null), if(doc_id % 23 = 5, 'empty question', null), if(doc_id % 29 = 0, 'stable is not a boolean', null),
    if(o and doc_id % 17 <> 2 and doc_id % 20 = 3, 'no unanswerable_reason', null), if(doc_id % 31 = 0 and doc_id % 2 = 0, 'no forbidden_strings', null),
    if((not o or doc_id % 17 = 2) and (doc_id % 13 = 0 or o), 'no required_citation_chunk_ids', null), if(not o and doc_id % 13 <> 0 and doc_id % 7 = 1, 'citation is no version-5 UUID', null),
    if((not o or doc_id % 17 = 2) and o and doc_id % 30 <> 3, 'empty source_docs', null), if((not o or doc_id % 17 = 2) and o, 'empty evidence_quotes', null), if((not o or doc_id % 17 = 2) and o, 'empty expected_answer_key_points', null),
    if(o and doc_id % 17 <> 2 and doc_id % 30 = 3, 'unanswerable with source_docs', null)], lambda x: x is not null)) as problem from i)
select item_id, problem from p
union all select null, 'fewer than 120 items' where (select count(*) from i) < 120
union all select null, 'unanswerable share below 0.1' where (select count(*) filter (o and doc_id % 17 <> 2) / count(*) from i) < 0.1
union all select null, 'fewer than 1 canaries' where (select count(*) filter (doc_id % 31 = 0) from i) < 1""")
def goldset_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gold set made of the documents, of which some break one rule or another."""
    k = F.col("doc_id")
    some, none = lambda c, v: F.when(c, F.array(v)).otherwise(F.array().cast("array<string>")), k % 10 == 3
    uuid = F.concat(F.lit("00000000-0000-"), F.when(k % 7 == 1, "4").otherwise("5"), F.lit("000-8000-"), F.lpad(k.cast("string"), 12, "0"))
    items = table(spark, sf_dir, "documents").select(
        k.alias("item_id"),
        F.when(k % 23 == 5, " ").otherwise("What holds?").alias("question"),
        F.when(k % 17 == 2, "essay").when(none, "unanswerable").otherwise("extractive").alias("answer_type"),
        F.when(k % 19 != 0, "easy").alias("difficulty"),
        F.when(k % 29 != 0, True).alias("stable"),
        (k % 31 == 0).alias("canary"),
        F.when(k % 20 != 3, "not in the corpus").alias("unanswerable_reason"),
        some(~none | (k % 30 == 3), F.lit("d")).alias("source_docs"),
        some(~none, F.lit("q")).alias("evidence_quotes"),
        some(~none & (k % 13 != 0), uuid).alias("required_citation_chunk_ids"),
        some(~none, F.lit("p")).alias("expected_answer_key_points"),
        some(k % 2 == 1, F.lit("x")).alias("forbidden_strings"),
    )
    return constraints.lint_goldset(items)


@query()
def turn_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the last turn of each conversation is from its first one (tests hold it against a plain version)."""
    turns = table(spark, sf_dir, "conversations")
    return drift.drift(turns.select(F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("term"), F.col("turn").alias("at"), F.lit(0).alias("doc_id"), "text")).withColumn("new_words", F.array_join("new_words", " "))
