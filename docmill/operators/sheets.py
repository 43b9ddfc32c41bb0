"""Any number of sheets in one job: a grid (sheet_id, row, col, name, value) of their cells as text.

A blank cell is left out of a repaired grid, and so are blank rows and columns. Every operator groups by
(sheet_id, ...), so the number of jobs doesn't depend on the number of sheets, and a sheet of any length is
dealt by its columns and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.words import exact_sum, ranked
from docmill.operators.tables import NUMBER

KINDS = ("bigint", "double", "boolean", "timestamp")


def sheet_grid(df: DataFrame, sheet: Column, row: Column, columns: dict[str, Column]) -> DataFrame:
    """A grid of ``df``: its rows as rows of their sheets, ``columns`` by name in order."""
    cells = [F.struct(F.lit(i).alias("col"), F.lit(n).alias("name"), c.cast("string").alias("value")) for i, (n, c) in enumerate(columns.items())]
    return df.select(sheet.alias("sheet_id"), row.cast("long").alias("row"), F.explode(F.array(*cells)).alias("c")).select("sheet_id", "row", "c.*")


def repair_sheets(grid: DataFrame) -> DataFrame:
    """The grid without blank cells, rows and columns. An ``Unnamed`` column takes its first value as
    its name if that is short and no number, else ``Column_i``."""
    held = grid.where(F.trim("value") != "")
    facts = held.groupBy("sheet_id", "col").agg(F.min("name").alias("name"), F.min_by(F.trim("value"), "row").alias("v"))
    told = (F.length("v") < 50) & ~F.col("v").rlike(NUMBER)
    named = F.when(~F.col("name").startswith("Unnamed"), F.col("name")).when(told, F.col("v")).otherwise(F.concat(F.lit("Column_"), "col"))
    return held.drop("name").join(facts.select("sheet_id", "col", named.alias("name")), ["sheet_id", "col"]).select("sheet_id", "row", "col", "name", "value")


def sheet_types(grid: DataFrame) -> DataFrame:
    """(sheet_id, col, name, type, n): each column's narrowest type that loses no value; codes with a leading
    zero or plus sign stay text."""
    v = F.trim("value")
    number = F.when(~v.rlike(r"^[-+]?0[0-9]|^[+]"), v)
    counts = [F.count((number if k in ("bigint", "double") else v).try_cast(k)).alias(k) for k in KINDS]
    facts = grid.where(v != "").groupBy("sheet_id", "col", "name").agg(F.count(F.lit(1)).alias("n"), *counts)
    kind = F.lit("string")
    for k in reversed(KINDS):
        kind = F.when(F.col(k) == F.col("n"), k).otherwise(kind)
    return facts.select("sheet_id", "col", "name", kind.alias("type"), "n")


def _first_rows(grid: DataFrame, n: int) -> DataFrame:
    rows = grid.select("sheet_id", "row").distinct().withColumn("r", ranked(["sheet_id"], F.asc("row")))
    return rows.where(F.col("r") <= n)


def describe_sheets(grid: DataFrame, samples: int = 3) -> DataFrame:
    """(sheet_id, columns, n_rows, sample): ``name (type)`` of all columns, and the first rows as text."""
    listed = F.array_sort(F.collect_list(F.struct("col", F.format_string("%s (%s)", "name", "type").alias("t"))))
    cols = sheet_types(grid).groupBy("sheet_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), ", ").alias("columns"))
    n = grid.select("sheet_id", "row").distinct().groupBy("sheet_id").agg(F.count(F.lit(1)).alias("n_rows"))
    cell = F.array_sort(F.collect_list(F.struct("col", F.format_string("%s: %s", "name", "value").alias("t"))))
    lines = grid.join(_first_rows(grid, samples), ["sheet_id", "row"]).groupBy("sheet_id", "r").agg(F.array_join(F.transform(cell, lambda x: x["t"]), " | ").alias("t"))
    sample = lines.groupBy("sheet_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), "\n").alias("sample"))
    return cols.join(n, "sheet_id").join(sample, "sheet_id").select("sheet_id", "columns", "n_rows", "sample")


def sheets_text(grid: DataFrame, block_rows: int = 1000) -> DataFrame:
    """(sheet_id, block, text): Markdown tables in blocks of ``block_rows`` row numbers; a sheet's first block
    also holds its name, columns and number of rows."""
    listed = F.array_sort(F.collect_list(F.struct("col", "name")))
    heads = grid.groupBy("sheet_id", "col").agg(F.min("name").alias("name")).groupBy("sheet_id").agg(listed.alias("cols"))
    cells = F.map_from_entries(F.collect_list(F.struct("col", "value")))
    rows = grid.groupBy("sheet_id", "row").agg(cells.alias("m")).join(heads, "sheet_id")
    line = F.concat(F.lit("| "), F.array_join(F.transform("cols", lambda c: F.coalesce(F.try_element_at("m", c["col"]), F.lit(""))), " | "), F.lit(" |"))
    rows = rows.select("sheet_id", "row", F.floor(F.col("row") / block_rows).alias("b"), line.alias("l"))
    blocks = rows.groupBy("sheet_id", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "l"))), lambda x: x["l"]), "\n").alias("t"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("sheet_id")
    blocks = blocks.withColumns({"block": F.row_number().over(w.orderBy("b")) - 1, "n": F.sum("n").over(w)}).join(heads, "sheet_id")
    names = F.transform("cols", lambda c: c["name"])
    bar = lambda x: F.concat(F.lit("| "), F.array_join(x, " | "), F.lit(" |"))
    head = F.concat_ws(
        "\n", F.concat(F.lit("Sheet: "), F.col("sheet_id").cast("string")), F.concat(F.lit("Columns: "), F.array_join(names, ", ")),
        F.concat(F.lit("Rows: "), F.col("n").cast("string")), F.lit(""), bar(names), bar(F.transform("cols", lambda _: F.lit("---"))), F.col("t"),
    )
    return blocks.select("sheet_id", "block", F.when(F.col("block") == 0, head).otherwise(F.col("t")).alias("text"))


def sheets_metrics(grid: DataFrame, most: int = 5) -> DataFrame:
    """(sheet_id, metric, value): each sheet's rows, and sum and mean of its first ``most`` numeric columns."""
    rows = grid.select("sheet_id", "row").distinct().groupBy("sheet_id").agg(F.count(F.lit(1)).cast("double").alias("value"))
    numeric = sheet_types(grid).where(F.col("type").isin("bigint", "double")).withColumn("r", ranked(["sheet_id"], F.asc("col"))).where(F.col("r") <= most)
    own = grid.join(numeric.select("sheet_id", "col"), ["sheet_id", "col"], "left_semi").withColumn("x", F.trim("value").try_cast("double"))
    sums = own.groupBy("sheet_id", "name").agg(exact_sum(F.col("x")).alias("s"), F.count("x").alias("k"))
    each = F.array(F.struct(F.concat("name", F.lit(" sum")).alias("metric"), F.col("s").alias("value")), F.struct(F.concat("name", F.lit(" mean")).alias("metric"), F.round(F.col("s") / F.col("k"), 6).alias("value")))
    return rows.select("sheet_id", F.lit("Rows").alias("metric"), "value").unionByName(sums.select("sheet_id", F.inline(each)))
