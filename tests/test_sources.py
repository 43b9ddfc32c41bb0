"""Readers, status and ingestion on small made inputs."""

import datetime as dt
import json

from docmill.operators import chat, tables
from docmill.sources import readers
from docmill.sources.versions import Versions
from docmill.streaming import status


def test_parsed_documents(spark, tmp_path):
    good = {"id": "a", "type": "pdf", "content": [{"number": 3, "text": "x"}, {"text": "y"}]}
    for name, text in (("a", json.dumps(good)), ("b", '{"id": "b", "content": ['), ("c", '{"type": "pdf"}'), ("d", '{"id": "d"}')):
        (tmp_path / f"{name}.json").write_text(text)
    got = readers.read_parsed_documents(spark, str(tmp_path)).select("id", "page_no", "text").collect()
    assert {tuple(r) for r in got} == {("a", 3, "x"), ("a", 2, "y"), ("d", None, None)}


def test_spreadsheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Amount,name,amount,2024 Q1,***\n1,a\u00a0\u200bb,1.5,x,\n2,c,2,y,\n")
    df = readers.read_spreadsheet_csv(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [
        ("amount", "bigint"), ("name", "string"), ("amount_2", "double"), ("col_2024_q1", "string"), ("column", "string"),
    ]
    assert sorted(r["name"] for r in df.collect()) == ["a b", "c"]


def test_inventory(spark, tmp_path):
    for name in ("a.PDF", "b.csv", "c.png", "d.zip"):
        (tmp_path / name).write_text("x")
    got = readers.file_inventory(spark, str(tmp_path)).collect()
    assert {(r["extension"], r["class"], r["length"]) for r in got} == {("pdf", "text", 1), ("csv", "spreadsheet", 1), ("png", "image", 1), ("zip", None, 1)}


def test_status(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 12, 0) + dt.timedelta(minutes=m)
    made = [(1, at(0), "pending"), (2, at(0), "pending"), (2, at(1), "done"), (3, at(29), "pending"), (4, at(5), "failed"), (1, at(1), "pending")]
    made += [(9, at(30), "done")]
    events = spark.createDataFrame(made, "id long, ts timestamp, s string")
    events.write.parquet(f"{tmp_path}/in")
    want = {r["id"]: r["status"] for r in status.generation_status(events, "id", "ts", "s", "2024-01-01 12:29:00").collect()}
    assert want == {1: "failed", 2: "done", 3: "pending", 4: "failed", 9: "done"}
    rows = []
    run = status.status_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "id", "ts", "s").writeStream.outputMode("update")
    run = run.foreachBatch(lambda b, e: rows.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r["id"]: r["status"] for r in rows} == want


def test_ingest_keeps_earlier_documents(spark, tmp_path):
    """Documents of earlier batches stay, one sent again leaves no stale chunks, a batch writes only its parts."""
    long_text = "\n\n".join(f"Paragraph {i} " + "word " * 200 for i in range(6))
    kind = "thread_id string, document_id string, page_no int, text string"
    for text in ([("old", long_text), ("both", long_text)], [("new", "new words"), ("both", "short now"), ("both", "short now")]):
        spark.createDataFrame([("t", i, 1, x) for i, x in text], kind).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        status.ingest_stream(s, f"{tmp_path}/index", f"{tmp_path}/state", parts=64).awaitTermination()
    rows = [r for r in status.current_index(spark, f"{tmp_path}/index").collect() if r["chunk_type"] == "child"]
    assert {r["document_id"] for r in rows} == {"old", "new", "both"}
    assert [r["parent_text"] for r in rows if r["document_id"] == "both"] == ["short now"] and len([r for r in rows if r["document_id"] == "old"]) > 5
    assert sum(v == 1 for v in Versions(spark, f"{tmp_path}/index").manifest()["chunks"].values()) <= 2


def test_finished_jobs_leave_the_state(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 12, 0) + dt.timedelta(minutes=m)
    rows = []
    for k, made in enumerate(([(1, at(0), "done"), (1, at(1), "done")], [(2, at(300), "done")], [(3, at(301), "done")])):
        spark.createDataFrame(made, "id long, ts timestamp, s string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        s = spark.readStream.schema("id long, ts timestamp, s string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        out = status.status_stream(s, "id", "ts", "s", keep_s=60)
        run = out.writeStream.outputMode("update").foreachBatch(lambda b, e: rows.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    assert sorted((r["id"], r["status"]) for r in rows) == [(1, "done"), (2, "done"), (3, "done")]
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_source_and_exports(spark):
    how, df = tables.resolve_sheet_source(spark, ["a"])
    assert (how, df.columns, df.count()) == ("empty", ["a"], 0)
    threads = spark.createDataFrame([(1, [("x", False)])], "t int, a array<struct<text string, selected boolean>>")
    assert chat.selected_instructions(threads, "t", "a").first()["texts"] == []
