"""Many sheets in one job, and a registry that outlives the session."""

from pyspark.sql import functions as F

from docmill.operators import sheets
from docmill.sources.readers import delete_cascade
from docmill.sources.registry import Registry


def grid(spark, rows):
    return spark.createDataFrame(rows, "sheet_id string, row long, col int, name string, value string")


def test_odd_sheets(spark):
    rows = [("a", 0, 0, "id", "007"), ("a", 1, 0, "id", "010"), ("a", 0, 1, "Unnamed: 1", ""), ("a", 1, 1, "Unnamed: 1", "4.5"), ("a", 5, 2, "gone", "  "), ("a", 6, 0, "id", None)]
    rows += [("b", 3, 0, "Unnamed: 0", "x" * 60), ("b", 4, 0, "Unnamed: 0", "y"), ("c", 0, 0, "only", None)]
    out = sheets.repair_sheets(grid(spark, rows))
    assert {(r["sheet_id"], r["row"], r["name"], r["value"]) for r in out.collect()} == {("a", 0, "id", "007"), ("a", 1, "id", "010"), ("a", 1, "Column_1", "4.5"), ("b", 3, "Column_0", "x" * 60), ("b", 4, "Column_0", "y")}
    assert {(r["sheet_id"], r["name"], r["type"]) for r in sheets.sheet_types(out).collect()} == {("a", "id", "string"), ("a", "Column_1", "double"), ("b", "Column_0", "string")}
    text = {r["sheet_id"]: r["text"] for r in sheets.sheets_text(out).collect()}
    assert text["a"].endswith("| id | Column_1 |\n| --- | --- |\n| 007 |  |\n| 010 | 4.5 |") and "Rows: 2" in text["a"]
    assert sheets.sheets_text(out.limit(0)).count() == 0


def test_the_number_of_jobs_does_not_depend_on_the_sheets(spark):
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for n in (1, 300):
        df = spark.range(n * 10).select(F.concat(F.lit("s"), (F.col("id") % n).cast("string")).alias("s"), "id")
        made = sheets.repair_sheets(sheets.sheet_grid(df, F.col("s"), F.col("id"), {"k": F.col("id"), "half": F.col("id") / 2}))
        spark.sparkContext.setJobGroup(f"sheets{n}", "")
        for f in (sheets.sheet_types, sheets.describe_sheets, sheets.sheets_text, sheets.sheets_metrics):
            assert f(made).select("sheet_id").distinct().count() == n
        counts.append(len(tracker.getJobIdsForGroup(f"sheets{n}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 4  # a join may turn out broadcast or not


def test_registry(spark, tmp_path):
    base = str(tmp_path / "reg")
    one, two = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2, "y")], "a int, b string")
    assert Registry(spark, base).rows().count() == 0 and Registry(spark, base).open() == []
    assert Registry(spark, base).register({("d1", "My file.xlsx", "S 1"): one, ("d2", "2024.csv", None): two}) == ["my_file_xlsx_s_1_d1", "t_2024_csv_d2"]
    spark.createDataFrame([(7, "z")], "a int, b string").write.option("header", True).csv(f"{tmp_path}/new")
    other = Registry(spark.newSession(), base)
    files = other.spark.createDataFrame([("d1", "f", "nowhere"), ("d3", "f.csv", f"{tmp_path}/new")], "doc_id string, file string, path string")
    assert [r["doc_id"] for r in other.missing(files).collect()] == ["d3"]
    assert other.reload_from_files(files) == ["f_csv_d3"] and other.reload_from_files(files) == []
    assert other.open() == ["f_csv_d3", "my_file_xlsx_s_1_d1", "t_2024_csv_d2"]
    assert other.spark.sql("SELECT a FROM f_csv_d3 UNION ALL SELECT a FROM t_2024_csv_d2 ORDER BY a").collect() == [(2,), (7,)]
    other.drop(files.where("doc_id = 'd1'"))
    assert Registry(spark, base).open() == ["f_csv_d3", "t_2024_csv_d2"]
    assert not (tmp_path / "reg" / "data" / "my_file_xlsx_s_1_d1").exists()


def test_a_copy_in_another_thread_keeps_its_triples(spark):
    chunks = spark.createDataFrame([("a", "d"), ("b", "d"), ("a", "e")], "thread_id string, document_id string")
    triples = spark.createDataFrame([("d", 1), ("e", 2)], "document_id string, n int")
    out = delete_cascade({"chunks": chunks, "triples": triples}, chunks.where("thread_id = 'a'"))
    assert [r["n"] for r in out["triples"].collect()] == [1] and out["chunks"].count() == 1
