"""Trees of any depth and with cycles, embeddings, nearest vectors by blocks, noisy replies, odd cells."""

import time

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from docmill.functions.words import tokens
from docmill.operators import chat, enrich, retrieve, tables, text


def test_deep_trees_and_cycles(spark):
    rows = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 1000)] + [("c1", "c3"), ("c2", "c1"), ("c3", "c2"), ("below", "c2"), ("self", "self"), ("lost", "gone"), ("r", ""), ("x", "lost")]
    out = {r["id"]: r for r in enrich.node_tree(spark, spark.createDataFrame(rows, "id string, parent_id string")).collect()}
    assert set(out) == {f"n{i}" for i in range(1000)} | {"r"}
    assert out["n999"]["depth"] == 999 and out["n999"]["root"] == "n0" and out["n2"]["path"] == "n0/n1/n2" and out["n998"]["n_children"] == 1
    assert enrich.node_tree(spark, spark.createDataFrame([], "id string, parent_id string")).count() == 0


def test_embeddings_are_hashed_tfidf_of_length_one(spark):
    rows = [(i, t) for i, t in enumerate(["alpha beta beta", "beta gamma", "Alpha, delta!", "", None])]
    df = spark.createDataFrame(rows, "id int, text string")
    made, fitted = retrieve.hashed_embeddings(df, "id", "text", 32)
    words = {r["id"]: r["w"] for r in df.select("id", tokens("text").alias("w")).collect()}
    at = HashingTF(numFeatures=32).indexOf
    n, own = len(rows), {i: np.bincount([at(w) for w in ws], minlength=32).astype(float) for i, ws in words.items()}
    idf = np.log((n + 1) / (sum((v > 0).astype(float) for v in own.values()) + 1))
    for r in made.collect():
        v = own[r["id"]] * idf
        assert np.allclose(r["v"], v / (np.linalg.norm(v) or 1), atol=1e-6)
    again, _ = retrieve.hashed_embeddings(df.where("id = 1"), "id", "text", 32, fitted)
    assert again.first()["v"] == made.where("id = 1").first()["v"]


@pytest.mark.parametrize("rows", [(2048, 65536), (3, 7)])
def test_nearest_vectors_by_blocks(spark, rows):
    rng = np.random.default_rng(2)
    v = rng.integers(-2, 3, (50, 4)).astype(float)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "chunk_id int, v array<double>")
    queries = spark.createDataFrame([(i, v[i * 5].tolist()) for i in range(8)] + [(77, None)], "query_id int, q array<double>")
    out = sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in retrieve.vector_topk(vectors, queries, 6, *rows).collect())
    want = []
    for q in range(8):
        best = sorted(range(50), key=lambda c: (-(v[q * 5] @ v[c]), c))[:6]  # noqa: B023
        want += [(q, k + 1, c, float(v[q * 5] @ v[c])) for k, c in enumerate(best)]
    assert out == want
    assert retrieve.vector_topk(vectors.limit(0), queries, 6).count() == 0


def test_replies(spark):
    assert chat.outermost_json('x {bad} {"other": 1} {"answer": {"b": 2}} "', ("answer",)) == '{"answer": {"b": 2}}'
    assert chat.outermost_json('{"other": 1}', ("answer",)) == '{"other": 1}' and chat.outermost_json("no object }{") is None
    assert chat.outermost_json('I said {"a": "line\nbreak \\" {"} and', ()) == '{"a": "line\\nbreak \\" {"}'
    for noise in ("{" * 200_000, '{"a": ' * 50_000, '{"' * 100_000):
        began = time.perf_counter()
        chat.outermost_json(noise)
        assert time.perf_counter() - began < 3
    df = spark.createDataFrame([(1, '{"note": 1} {"answer": "yes"}'), (2, "plain"), (3, "")], "id int, raw string")
    out = {r["id"]: r for r in chat.parse_responses(df, "raw", "answer string").collect()}
    assert (out[1]["parsed"]["answer"], out[2]["parsed"]["answer"], out[2]["error"], out[3]["error"]) == ("yes", "plain", "no json", "empty")


def test_splitting_is_linear_and_whole():
    began = time.perf_counter()
    parts = text.split_recursive("x" * 1_000_000, 1500, 150)
    assert time.perf_counter() - began < 5 and max(map(len, parts)) <= 1500 and all(p == "x" * len(p) for p in parts)


def test_codes_stay_text_and_names_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("007", "1", "0.5", "+3"), ("010", "20", "0", "4")], "a string, b string, c string, d string")
    assert [t for _, t in tables.infer_types(df).dtypes] == ["string", "bigint", "double", "string"]
    rows = [(i, "" if i < 3 else f"name {i}") for i in range(20)]
    for n in (1, 7):
        out = tables.repair_table(spark.createDataFrame(rows, "k int, `Unnamed: 1` string").repartition(n), ["k"])
        assert out.columns == ["k", "name 3"]


def test_long_sheets_come_in_blocks(spark):
    df = spark.range(2500).select("id", (F.col("id") * 2).alias("twice"))
    out = tables.sheet_text(df, "s", ["id"], block_rows=500).orderBy("block").collect()
    assert len(out) >= 4 and [r["block"] for r in out] == list(range(len(out)))
    lines = "\n".join(r["text"] for r in out).split("\n")
    assert lines[2] == "Rows: 2500" and lines[6:] == [f"| {i} | {2 * i} |" for i in range(2500)]
    assert tables.sheet_text(df.limit(0), "s", ["id"]).first()["text"].endswith("|")
