"""Queries that work on all hits and on the documents' own whole texts."""

from pyspark.sql import functions as F

from docmill.plans.queries import QUERIES, hits

SF = "/root/testdata/sf0.001"


def test_hits_from_rank_10_on_take_part(spark):
    held = {(r["query_id"], r["chunk_id"]): r["rank"] for r in hits(spark, SF).collect()}
    sims = QUERIES["tfidf_cosine"](spark, SF).collect()
    assert max(max(held[r["query_id"], r["a"]], held[r["query_id"], r["b"]]) for r in sims) >= 10
    chosen = QUERIES["mmr_select"](spark, SF).collect()
    assert max(held[r["query_id"], r["chunk_id"]] for r in chosen) >= 10


def test_mentions_of_whole_texts(spark):
    out = QUERIES["whole_text_mentions"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    late = out.join(docs, "doc_id").where(F.expr("locate(name, text) > 5000"))
    assert out.where("rank > 15").count() > 0 and late.count() > 0
