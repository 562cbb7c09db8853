"""One search over texts, vectors and a graph: three arms, fused, boosted, and each arm's first kept in place."""

from __future__ import annotations

import functools
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import retrieval, search
from tidemark.sources.tables import materialise


@dataclass(frozen=True)
class Search:
    """How deep each arm goes, how many results there are, and what arms, relations and hops weigh."""

    depth: int = 20
    k: int = 5
    rrf_k: int = 60
    weights: Mapping[str, float] = field(default_factory=lambda: {"lexical": 1.0, "dense": 1.0, "graph": 0.5})
    seeds: int = 3
    hops: int = 2
    decay: float = 0.85
    relations: Mapping[str, float] = field(default_factory=dict)
    other_relation: float = 0.7
    centrality: float = 0.15


def dense_arm(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score, rank) of the ``k`` nearest by cosine; zero, null and vectors of another length take no part.

    ``queries`` (item_id, embedding) is a stated set: it meets all of ``vectors`` (doc_id, embedding).
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = lambda rows, key: rows.withColumn("norm", norm).filter("norm > 0").select(key, F.size("embedding").alias("d"), F.transform("embedding", lambda x: x.cast("double") / F.col("norm")).alias(f"{key}_v"))
    pairs = unit(vectors, "doc_id").join(unit(queries, "item_id"), "d")
    dot = F.aggregate(F.zip_with("item_id_v", "doc_id_v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("item_id", "doc_id", F.round(dot, 6).alias("score")).filter("score is not null")
    return retrieval.ranked(scored, "item_id", [F.desc("score"), F.asc("doc_id")], k)


def graph_arm(seeds: DataFrame, edges: DataFrame, how: Search) -> DataFrame:
    """(item_id, doc_id, score, rank) of what the seeds (item_id, doc_id) of each query lead to; each step's reach is kept apart by query.

    ``edges``: (src, dst, relation). A document's score is its relation's weight by decay to the number of hops,
    the best of all ways; seeds are no results.
    """
    weight = functools.reduce(lambda rest, r: F.when(F.col("relation") == r, how.relations[r]).otherwise(rest), how.relations, F.lit(how.other_relation))
    at, found = seeds.select("item_id", "doc_id").distinct(), []
    for hop in range(1, how.hops + 1):
        step = at.withColumnRenamed("doc_id", "src").join(edges, "src").groupBy("item_id", F.col("dst").alias("doc_id")).agg(F.max(weight * how.decay**hop).alias("score"))
        found.append(step)
        at = step.select("item_id", "doc_id")
    best = functools.reduce(DataFrame.unionAll, found).groupBy("item_id", "doc_id").agg(F.round(F.max("score"), 9).alias("score"))
    return retrieval.ranked(best.join(seeds.select("item_id", "doc_id").distinct(), ["item_id", "doc_id"], "left_anti"), "item_id", [F.desc("score"), F.asc("doc_id")], how.depth)


def hybrid_search(items: DataFrame, docs: DataFrame, item_vectors: DataFrame, doc_vectors: DataFrame, edges: DataFrame, *, keep: Column | None = None, tier: Column | None = None, how: Search = Search()) -> DataFrame:  # noqa: B008
    """(item_id, doc_id, score, rank, arm_ranks, anchored_arm) of each query's ``how.k`` best documents.

    ``items`` (item_id, text) are the queries, ``docs`` (doc_id, text and what ``keep`` and ``tier`` read) the corpus; vectors
    hold (item_id, embedding) and (doc_id, embedding), ``edges`` (src, dst, relation). ``keep`` is a condition on ``docs`` that
    holds in every arm, before it ranks: a document that a caller may not see is no neighbour and no step of a way, either.
    Reciprocal ranks are summed, then raised by the document's tier of authority and by how often it is cited; each arm's
    first has a place among the results. Queries whose arms are all empty have no rows.
    """
    seen = docs.filter(keep) if keep is not None else docs
    rank_of = tier if tier is not None else F.lit(0)
    known = materialise(seen.select("doc_id", rank_of.alias("tier")), "hybrid-docs")
    inside = lambda rows, column: rows.join(known.select(F.col("doc_id").alias(column)), column, "left_semi")
    ways = inside(inside(edges.filter("src <> dst"), "src"), "dst").select("src", "dst", "relation").distinct()
    lexical = retrieval.bm25(items, seen.select("doc_id", "text"), k=how.depth)
    lexical = materialise(lexical.select("item_id", "doc_id", "score", "rank"), "hybrid-lexical")
    dense = dense_arm(item_vectors, inside(doc_vectors, "doc_id"), how.depth)
    graph = graph_arm(lexical.filter(F.col("rank") <= how.seeds), ways, how).withColumn("edge", F.col("score"))
    arms = {"lexical": lexical, "dense": dense, "graph": graph}
    arms = {name: materialise(rows.select("item_id", "doc_id", "rank", *(["edge"] if "edge" in rows.columns else [])), f"hybrid-{name}") for name, rows in arms.items()}
    fused = search.tri_arm_fusion(arms, "item_id", "doc_id", weights=how.weights, rrf_k=how.rrf_k)
    cited = search.centrality(ways, "dst").withColumnRenamed("dst", "doc_id")
    raised = search.authority_boost(search.centrality_boost("score", "centrality", how.centrality), "tier")
    scored = fused.join(known, "doc_id").join(cited, "doc_id", "left").select("item_id", "doc_id", F.round(raised, 9).alias("score"), "arm_ranks")
    scored = materialise(scored, "hybrid-fused")
    leaders = functools.reduce(DataFrame.unionAll, (rows.filter("rank = 1").select("item_id", "doc_id", F.lit(name).alias("arm")) for name, rows in arms.items() if how.weights.get(name, 1.0) > 0))
    best = search.anchor_arm_leaders(scored, leaders, "item_id", "doc_id", how.k)
    return best.join(scored.select("item_id", "doc_id", "arm_ranks"), ["item_id", "doc_id"], "left").select("item_id", "doc_id", "score", "rank", "arm_ranks", "anchored_arm")
