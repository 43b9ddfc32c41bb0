"""The pass over a document's rows: long documents, batches and threads, against plain counts."""

import re
from collections import Counter
from functools import partial

from pyspark.sql import functions as F

from docmill.operators import enrich
from docmill.plans import documents, pipelines
from docmill.plans.pipelines import build_chunk_index, document_manifest

KIND = "thread_id string, document_id string, page_no int, title string, text string"


def made(n):
    words = lambda p: " ".join(f"word{chr(97 + (p * k) % 26)}" for k in range(1, 30))
    return [(t, d, p, f"Title {d}", f"Alpha{chr(97 + p % 5)} of {words(p)}.\n\nGamma Delta came.") for t in ("a", None) for d in ("d", "e", None) for p in range(1, n + 1)]


def test_one_pass_over_the_pages(spark):
    """Pages are chunked once and dealt once, without a join; before, each of the three kinds of rows read them again."""
    out = build_chunk_index(spark.createDataFrame(made(2), KIND))
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Join" not in plan and len(re.findall(r"\bExchange ", plan)) == 1 and plan.count("MapInArrow") == 1


def test_rows_of_long_documents_and_small_batches(spark, monkeypatch):
    rows = made(60)
    pages = spark.createDataFrame(rows, KIND)
    plain = sorted(map(str, build_chunk_index(pages).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        monkeypatch.setattr(pipelines, "with_documents", partial(documents.with_documents, held_bytes=2000))
        own = build_chunk_index(pages)
        assert sorted(map(str, own.collect())) == plain
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["n_pages"] for r in document_manifest(own).collect()} == {60}
    text = {r["page_no"]: r["text"] for r in own.where("thread_id IS NULL AND document_id IS NULL AND chunk_type = 'child'").collect()}
    count = Counter(w for t, d, _, _, x in rows if t is None and d is None for w in re.findall("[a-z]+", x.lower()) if len(w) > 2)
    best = [w for w, _ in sorted(count.items(), key=lambda x: -x[1])[:8]]
    assert len(text) == 60 and all(f"Page: {p}/60\n" in x and f"Topics: {', '.join(best)}\n" in x for p, x in text.items())


def test_spooled_rows_come_back_whole():
    import pyarrow as pa

    held = documents.Held()
    batch = pa.RecordBatch.from_pydict({"x": ["y" * 1000] * 1000})
    for _ in range(100):
        held.add(batch)
    assert held.file is not None and sum(b.num_rows for b in held.all()) == 100_000


def test_names_after_letters_beyond_the_basic_plane(spark):
    df = spark.createDataFrame([("\U0001d400Hello Xa, \U0001f600Bee Ceeé aZed Za1 Öl Ää",)], "text string")
    assert df.select(enrich.entity_names(F.col("text"))).first()[0] == ["Xa", "Bee Ceeé", "Öl Ää"]
