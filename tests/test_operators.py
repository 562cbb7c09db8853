"""Empty tables, nulls, ties and cycles have defined results."""

from tidemark.operators import graph, measures, texts


def test_chain_ends_on_cycles_and_unknown_successors(spark):
    rows = [(1, 2), (2, 3), (3, None), (4, 5), (5, 4), (6, 99)]
    found = graph.chain_ends(spark.createDataFrame(rows, "node long, next long"))
    assert {r.node: (r["last"], r.steps) for r in found.collect()} == {1: (3, 2), 2: (3, 1), 3: (3, 0), 4: (None, None), 5: (None, None), 6: (99, 1)}
    assert graph.chain_ends(spark.createDataFrame([], "node long, next long")).count() == 0


def test_ranks_add_up_to_one(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (1, 3)], "src long, dst long")
    ranks = {r.node: r["rank"] for r in graph.pagerank(edges, iterations=7).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[3] > ranks[2] > ranks[1]
    assert graph.pagerank(edges.limit(0), iterations=2).count() == 0


def test_hops_leave_seeds_out_and_keep_the_best_score(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("a", "b", "y"), ("b", "a", "x"), ("b", "c", "y")], "src string, dst string, relation string")
    seeds = spark.createDataFrame([("a",), ("a",)], "node string")
    found = {r.node: round(r.score, 6) for r in graph.k_hop(seeds, edges, {"x": 1.0}, decay=0.5).collect()}
    assert found == {"b": 0.5, "c": 0.175}


def test_group_scores_by_hand(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "q long, d long, rank int")
    groups = spark.createDataFrame([(1, 11, "a"), (1, 12, "a"), (1, 99, "b"), (2, 10, "c")], "q long, d long, group string")
    found = {r.q: (r.recall, r.hit, r.reciprocal_rank, r.ndcg) for r in measures.group_scores(ranked, groups, "q", "d", k=2).collect()}
    assert found == {1: (0.5, True, 0.5, 0.386853), 2: (0.0, False, 0.0, 0.0)}


def test_measures_of_empty_tables(spark):
    empty = spark.createDataFrame([], "ident long, delta double, a boolean, b boolean, x string, y string")
    assert measures.paired_bootstrap(empty, "ident", "delta", iterations=4).first().low is None
    assert measures.mcnemar(empty, "a", "b").first().asDict() == {"only_a": 0, "only_b": 0, "statistic": 0.0}
    assert measures.multiclass_kappa(empty, "x", "y").count() == 1


def test_text_expressions_on_nulls_and_blanks(spark):
    rows = spark.createDataFrame([(None,), ("",), (" A  b\n",), ("a B",)], "t string")
    found = rows.select(texts.fingerprint("t").alias("f"), texts.approximate_tokens("t").alias("n"), texts.masked("t").alias("m")).collect()
    assert found[0].f is None and found[0].m is None and found[2].f == found[3].f != found[1].f
    assert [r.n for r in found[1:]] == [1, 2, 2]
