"""The stored keyword index against one built anew."""

from pyspark.sql import functions as F

from docmill.operators import lexical, retrieve
from docmill.sources.versions import Versions


def weights(df):
    return sorted((str(r["thread"]), r["term"], r["chunk_id"], round(r["weight"], 9)) for r in df.collect())


def test_an_updated_index_is_one_built_anew(spark, tmp_path):
    words = "alpha beta gamma delta epsilon the and Été über x1".split()
    text = lambda i, k: " ".join(words[(i * j + k) % len(words)] for j in range(1 + i % 7))
    made = {i: (f"t{i % 3}", i, text(i, 0)) for i in range(60)} | {90: ("t1", 90, None), 91: ("t1", 91, "..."), 92: ("u", 92, "")}
    kind = "thread string, id long, text string"
    store = Versions(spark, f"{tmp_path}/index")
    frame = lambda rows: spark.createDataFrame(list(rows), kind)
    asked = frame([("t", 0, " ".join(words) + " never")])
    anew = lambda: weights(retrieve.bm25_index(frame(made.values()), "thread", "id", "text", terms=retrieve.query_terms(asked, "text")))
    now = lambda: weights(lexical.postings(store, retrieve.query_terms(asked, "text")))
    lexical.write_index(store, frame(made.values()), "thread", "id", "text", 8)
    assert now() == anew() and len(now()) > 100
    before = store.manifest()["postings"]
    change = [("t0", 3, "alpha alpha new words"), ("t2", 200, "the the the"), ("v", 201, "beta")]
    made |= {i: (t, i, x) for t, i, x in change}
    gone = [(made[i][0], i) for i in (1, 4, 91)]
    for _, i in gone:
        del made[i]
    lexical.update_index(store, frame(change), spark.createDataFrame(gone, "thread string, id long"), "thread", "id", "text", 8)
    assert now() == anew()
    after = store.manifest()["postings"]
    assert 0 < sum(after.get(p) == before.get(p) for p in range(8)) < 8


def test_counts_of_terms(spark):
    df = spark.createDataFrame([(1, "a", "b A b"), (2, "a", None), (3, None, "ß c_1 c_1")], "id int, thread string, text string")
    got = sorted(map(tuple, lexical.term_counts(df, "thread", "id", "text").where("term is not null").select("chunk_id", "term", "tf", "dl").collect()))
    assert got == [(1, "a", 1, 3), (1, "b", 2, 3), (3, "c_1", 2, 3), (3, "ß", 1, 3)]
    assert lexical.term_counts(df, "thread", "id", "text").where(F.col("term").isNull()).count() == 1


def test_hits_without_a_content_stay(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, None), (1, 2, "x"), (1, 3, "x")], "query_id int, rank int, text string")
    assert sorted(r["rank"] for r in retrieve.dedup_content_hash(df, "text").collect()) == [0, 1, 2]


def test_best_hits_are_found_without_a_row_for_each_query_and_chunk(spark, monkeypatch):
    """What is shuffled were the scores of all chunks for all queries; now it is the postings and each task's best."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    made = [(f"t{i % 3}" if i % 7 else None, i, " ".join(words[(i * j) % 8] for j in range(1 + i % 5))) for i in range(400)]
    chunks = spark.createDataFrame(made, "thread string, id long, text string")
    asked = spark.createDataFrame([(q, f"{words[q % 8]} {words[q // 8 % 8]} {words[q % 8]} never") for q in range(40)], "q int, text string").selectExpr("struct(q, q % 2 AS h) AS q", "text")
    postings = retrieve.bm25_index(chunks, "thread", "id", "text").localCheckpoint()
    rows = lambda: sorted(map(str, retrieve.bm25_topk(postings, asked, "q", "text", 3).collect()))
    found = rows()
    plan = retrieve.bm25_topk(postings, asked, "q", "text", 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan
    with monkeypatch.context() as m:
        m.setattr(retrieve, "ASKED", 10)  # by joins
        assert rows() == found and len(found) > 100
    with monkeypatch.context() as m:
        m.setattr(retrieve, "AT_A_TIME", 9)
        m.setattr(retrieve, "WAITING", 20)
        assert rows() == found


def test_an_index_deals_chunks_and_not_postings(spark, tmp_path):
    df = spark.createDataFrame([(f"t{i % 2}", i, "a b c " * (1 + i % 3)) for i in range(50)], "thread string, id long, text string")
    store = Versions(spark, f"{tmp_path}/index")
    lexical.write_index(store, df, "thread", "id", "text", 5)
    terms = store.read("terms").groupBy("part", "thread", "term").agg(F.sum("df").alias("n"))
    plain = store.read("postings").groupBy("part", "thread", "term").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(str, terms.collect())) == sorted(map(str, plain.collect())) and terms.count() == 2 * 5 * 3
    assert "Exchange" not in lexical._runs(store.read("postings"))._jdf.queryExecution().executedPlan().toString()
