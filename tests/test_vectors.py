"""Cells against the exact search on vectors that form groups; scopes."""

import re

import numpy as np
from pyspark.sql import functions as F

from docmill.operators import cells, retrieve


def test_cells_of_grouped_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    v = centres[np.arange(1000) % 20] + 0.1 * rng.normal(size=(1000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)] + [(5000, None, 0), (5001, [], 0)], "chunk_id long, v array<double>, half int")
    asked = df.where("chunk_id % 10 = 0 AND size(v) > 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"), "half")
    cells.build_cells(df, str(tmp_path), 20)
    found = cells.cell_topk(spark, str(tmp_path), asked, 10, 3)
    exact = retrieve.vector_topk(df.where("size(v) > 0"), asked, 10)
    assert cells.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.99
    first = asked.where("query_id = 0")
    for probes, pruned in ((1, r"\(cell#\d+ = \d+\)\]"), (3, r"cell#\d+ IN \(\d+,\d+,\d+\)")):  # Spark writes one value as =
        plan = cells.cell_topk(spark, str(tmp_path), first, 5, probes)._jdf.queryExecution().executedPlan().toString()
        filters = [x for x in re.findall(r"PartitionFilters: \[.*?\](?=,)", plan)]
        assert filters and all(re.search(pruned, x) for x in filters)
    everything = cells.cell_topk(spark, str(tmp_path), asked, 10, 20, ["half"], block_rows=7)
    scoped = retrieve.vector_topk(df.where("size(v) > 0"), asked, 10, scope=["half"])
    rows = lambda x: sorted(map(tuple, x.select("query_id", "rank", "chunk_id", "score").collect()))
    assert rows(everything) == rows(scoped)
    assert all(q % 2 == c % 2 for q, _, c, _ in rows(scoped))


def test_products_of_a_block_are_bounded_and_ties_are_in_order():
    """A block of 2,048 queries and 65,536 vectors made all its scores at once, a gigabyte in each of four arrays."""
    import tracemalloc

    rng = np.random.default_rng(3)
    own, asked = rng.integers(-2, 3, size=(40_000, 4)).astype(float), rng.integers(-2, 3, size=(500, 4)).astype(float)
    tracemalloc.start()
    found = {i: (near.tolist(), score.tolist()) for i, near, score in retrieve.top_places(own, asked, 10)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6 < 500 * 40_000 * 8
    whole = np.round(asked @ own.T, 6)
    for i in range(0, 500, 37):
        best = np.argsort(-whole[i], kind="stable")[:10]
        assert found[i] == (best.tolist(), whole[i][best].tolist())
    assert [near.tolist() for _, near, _ in retrieve.top_places(own[:3], asked[:2], 10, 1)] == [np.argsort(-x, kind="stable").tolist() for x in whole[:2, :3]]


def test_queries_of_a_cell_are_dealt_into_blocks(spark, tmp_path):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 8)))], "chunk_id long, v array<double>")
    asked = df.select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))
    cells.build_cells(df, str(tmp_path), 4)
    out = lambda n: sorted(map(tuple, cells.cell_topk(spark, str(tmp_path), asked, 5, 4, query_rows=n).collect()))
    assert out(7) == out(8192) == sorted(map(tuple, retrieve.vector_topk(df, asked, 5).select("query_id", "chunk_id", "score", "rank").collect()))
