"""Spreadsheets and tables in text: headers, names, types, registry, guarded SQL, summaries."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.words import exact_sum, ranked
from docmill.operators.retrieve import count_tokens

NUMBER = r"^\s*[-+]?[0-9][0-9,]*(\.[0-9]+)?\s*%?\s*$"
#: Words a query may not hold.
REFUSED = ("insert", "update", "delete", "drop", "create", "alter", "truncate")


def detect_header(grid: DataFrame, scan: int = 20, least: float = 0.3) -> DataFrame:
    """(sheet_id, header_row, score, context) of grid (sheet_id, row, cells)."""
    filled = F.filter("cells", lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0)
    g = grid.where(F.col("row") < scan).withColumn("f", filled).withColumn("n", F.size("f"))
    words = F.size(F.filter("f", lambda c: ~c.rlike(NUMBER)))
    score = 0.4 * words / F.col("n") + 0.3 * F.size(F.array_distinct("f")) / F.col("n") + 0.3 * F.col("n") / F.size("cells")
    g = g.where("n > 0").withColumn("score", F.round(score * F.when(F.col("n") < 2, 0.1).otherwise(1.0), 6))
    best = g.withColumn("r", ranked(["sheet_id"], F.desc("score"), F.asc("row"))).where("r = 1")
    best = best.select("sheet_id", F.when(F.col("score") < least, 0).otherwise(F.col("row")).alias("header_row"), "score")
    line = g.select("sheet_id", "row", F.array_join("f", " ").alias("line")).join(best, "sheet_id").where("row < header_row")
    above = line.groupBy("sheet_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("context"))
    return best.join(above, "sheet_id", "left")


def flatten_headers(pairs: DataFrame) -> DataFrame:
    """(sheet_id, names) of two header rows (upper, lower) joined by ``_``; ``Column_i`` for none."""
    blank = lambda c: c.isNull() | (F.trim(c) == "") | (F.lower(c) == "nan") | c.startswith("Unnamed")
    join = lambda a, b: F.array_join(F.filter(F.array(a, b), lambda c: ~blank(c)), "_")
    names = F.zip_with("upper", "lower", join)
    return pairs.select("sheet_id", F.transform(names, lambda n, i: F.when(n == "", F.concat(F.lit("Column_"), i.cast("string"))).otherwise(n)).alias("names"))


def sanitize_names(columns: DataFrame, prefix: str = "col_") -> DataFrame:
    """(sheet_id, pos, name, clean): lower-case identifiers; repeats get the next free number."""
    base = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace("name", r"[^a-zA-Z0-9_]", "_"), "_+", "_"), "^_+|_+$", ""))
    base = F.when(base == "", F.lit("column")).when(base.rlike("^[0-9]"), F.concat(F.lit(prefix), base)).otherwise(base)
    start = F.struct(F.array().cast("array<string>").alias("used"))

    def free(used, b):
        tries = F.concat(F.array(b), F.transform(F.sequence(F.lit(2), F.size(used) + 2), lambda k: F.concat(b, F.lit("_"), k.cast("string"))))
        return F.get(F.filter(tries, lambda x: ~F.array_contains(used, x)), F.lit(0))

    fold = lambda cols: F.aggregate(cols, start, lambda s, c: F.struct(F.array_append(s["used"], free(s["used"], c["b"])).alias("used")), lambda s: s["used"])
    own = columns.withColumn("b", base).groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "b"))).alias("cols"))
    z = own.select("sheet_id", F.explode(F.arrays_zip("cols", fold(F.col("cols")).alias("clean"))).alias("z"))
    return z.select("sheet_id", F.col("z.cols.pos").alias("pos"), F.col("z.cols.name").alias("name"), F.col("z.clean").alias("clean"))


def repair_table(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Without all-null columns and blank rows; ``Unnamed`` columns take a short first value as name.
    The first row is the least in ``order`` (all columns by default), whatever the partitions are."""
    first = F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order or df.columns)])
    facts = df.agg(*[F.count(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))).alias(f"n{i}") for i, c in enumerate(df.columns)],
                   *[F.min_by(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")), F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", first)).alias(f"v{i}") for i, c in enumerate(df.columns)]).first()
    kept = []
    for i, c in enumerate(df.columns):
        if facts[f"n{i}"]:
            v = facts[f"v{i}"]
            named = v if c.startswith("Unnamed") and len(v) < 50 and not re.match(NUMBER, v) else f"Column_{i}" if c.startswith("Unnamed") else c
            kept.append(F.col(f"`{c}`").alias(named))
    out = df.select(*kept)
    some = reduce(lambda a, b: a | b, [F.length(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))) > 0 for c in out.columns], F.lit(False))
    return out.where(some)


def infer_types(df: DataFrame) -> DataFrame:
    """String columns cast to the narrowest type that loses no value: one aggregate over the table.
    Digits with a leading zero or plus sign are no numbers: codes such as 007 stay text."""
    kinds = ["bigint", "double", "boolean", "timestamp"]
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    value = {c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in text}
    if not text:
        return df
    code = lambda v, k: F.when(~v.rlike(r"^[-+]?0[0-9]|^[+]"), v) if k in ("bigint", "double") else v
    facts = df.agg(*[F.count(v if k == "" else code(v, k).try_cast(k)).alias(f"{i}{k}") for i, v in enumerate(value.values()) for k in ["", *kinds]]).first()
    casts = {}
    for i, (c, v) in enumerate(value.items()):
        kind = next((k for k in kinds if facts[f"{i}"] and facts[f"{i}{k}"] == facts[f"{i}"]), "string")
        casts[c] = v.try_cast(kind) if kind != "string" else F.col(f"`{c}`")
    return df.withColumns(casts)


def table_name(file: str, doc_id: str, sheet: str | None = None) -> str:
    clean = re.sub("_+", "_", re.sub(r"[^a-zA-Z0-9_]", "_", "_".join(x for x in (file, sheet, doc_id) if x))).strip("_").lower()
    return f"t_{clean}" if re.match("[0-9]", clean) else clean


def register_tables(spark: SparkSession, sheets: dict[tuple[str, str, str | None], DataFrame]) -> DataFrame:
    """Views for (doc_id, file, sheet) -> table; returns the registry (doc_id, table_name)."""
    rows = []
    for (doc_id, file, sheet), df in sheets.items():
        name = table_name(file, doc_id, sheet)
        df.createOrReplaceTempView(name)
        rows.append((doc_id, name))
    return spark.createDataFrame(rows, "doc_id string, table_name string")


def missing_tables(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(registry, "doc_id", "left_anti")


def describe_tables(tables: dict[str, DataFrame], samples: int = 3) -> DataFrame:
    """(table_name, columns, n_rows, sample): sample rows as JSON, in key order."""
    parts = []
    for name, df in tables.items():
        cols = ", ".join(f"{f.name} ({f.dataType.simpleString()})" for f in df.schema)
        head = df.orderBy(*df.columns).limit(samples).agg(F.array_join(F.collect_list(F.to_json(F.struct(*df.columns))), "\n").alias("sample"))
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).join(head, F.lit(True)).select(F.lit(name).alias("table_name"), F.lit(cols).alias("columns"), "n_rows", "sample"))
    return reduce(DataFrame.unionByName, parts)


def check_select(query: str) -> str | None:
    """Why a query is refused, or None."""
    text = query.strip()
    if not re.match(r"(?i)select\b", text):
        return "only SELECT queries are allowed"
    found = next((w for w in REFUSED if re.search(rf"(?i)\b{w}\b", text)), None)
    return f"the word {found} is not allowed" if found else None


def guarded_select(spark: SparkSession, query: str, max_rows: int | None = 500) -> tuple[DataFrame | None, int, bool, str | None]:
    """(rows, full count, truncated, error) of one SELECT; errors are returned, not raised."""
    if error := check_select(query):
        return None, 0, False, error
    key = "spark.sql.ansi.doubleQuotedIdentifiers"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "true")
        out = spark.sql(query)
        n = out.count()
        return (out if max_rows is None else out.limit(max_rows)), n, max_rows is not None and n > max_rows, None
    except Exception as e:  # the caller shows it to whoever asked
        return None, 0, False, str(e).splitlines()[0]
    finally:
        spark.conf.set(key, before)


def _fold_lines(lines, starts, inside):
    """Runs of lines (arrays): a line that ``starts`` one opens it, lines ``inside`` and blank ones
    go on with it, any other ends it. Blank lines are not part of a run."""
    first = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("held"))
    closed = lambda s: F.when(F.size(s["held"]) > 0, F.array_append(s["done"], s["held"])).otherwise(s["done"])
    empty = F.array().cast("array<string>")

    def step(s, x):
        going = (F.size(s["held"]) > 0) & inside(x)
        held = F.when(x == "", s["held"]).when(going, F.array_append(s["held"], x)).when(starts(x), F.array(x)).otherwise(empty)
        return F.struct(F.when((x == "") | going, s["done"]).otherwise(closed(s)).alias("done"), held.alias("held"))

    return F.aggregate(lines, first, step, closed)


def extract_tables(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, table_no, row, cells) of the tables in a text, row 0 the header, other rows fitted to it:
    Markdown (lines that start and end with a pipe, a rule among them), then ``[Table]`` blocks
    with Markdown or ``a | b`` lines; where there are neither, runs of loose ``a | b`` lines. Blank
    lines break no run; a header alone is no table. A text is one row, so nothing is shuffled."""
    text = F.coalesce(text_col, F.lit(""))
    block = r"(?is)\[Table\](.*?)\[/Table\]"
    trimmed = lambda c: F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    full = lambda x: x.rlike(r"^\|.*\|$")
    rule = lambda x: F.contains(x, F.lit("-")) & x.rlike(r"^[\s:|-]+$")
    loose = lambda x: F.contains(x, F.lit(" | ")) & ~x.startswith("[")
    piped = F.filter(_fold_lines(trimmed(F.regexp_replace(text, block, "\n")), full, full), lambda run: F.exists(run, rule))
    inside = F.transform(F.regexp_extract_all(text, F.lit(block), F.lit(1)), lambda b: F.filter(trimmed(b), lambda x: x != ""))
    tagged = F.filter(inside, lambda run: (F.size(run) > 0) & (F.get(run, F.lit(0)).startswith("|") | F.contains(F.get(run, F.lit(0)), F.lit(" | "))))
    strict = docs.select(id_col, text.alias("_text"), F.concat(piped, tagged).alias("_runs"))
    spaced = _fold_lines(trimmed(F.col("_text")), lambda x: loose(x) & ~x.startswith("|"), loose)
    runs = strict.select(id_col, F.when(F.size("_runs") > 0, F.col("_runs")).otherwise(F.filter(spaced, lambda r: F.size(r) >= 2)).alias("_runs"))
    split = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = runs.select(id_col, F.transform("_runs", lambda run: F.transform(F.filter(run, lambda x: ~rule(x)), split)).alias("_tables"))
    rows = rows.select(id_col, F.posexplode(F.filter("_tables", lambda t: F.size(t) > 1)).alias("_t", "_rows")).withColumn("_width", F.size(F.get("_rows", F.lit(0))))
    out = rows.select(id_col, (F.col("_t") + 1).alias("table_no"), "_width", F.posexplode("_rows").alias("row", "cells"))
    fitted = F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda i: F.coalesce(F.get("cells", i), F.lit("")))
    return out.select(id_col, "table_no", "row", fitted.alias("cells"))


def table_catalog(docs: DataFrame, tables: DataFrame, id_col: str, preview: int = 3) -> DataFrame:
    """(id, n_tables, has_tables, columns, preview) with the first table's header and first rows."""
    n = tables.groupBy(id_col).agg(F.countDistinct("table_no").alias("n_tables"))
    first = tables.where(F.col("table_no") == 1).where(F.col("row") <= preview).groupBy(id_col)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: F.array_join(x["cells"], " | "))
    first = first.agg(rows.alias("r")).select(id_col, F.get("r", F.lit(0)).alias("columns"), F.array_join(F.slice("r", 2, preview), "\n").alias("preview"))
    out = docs.select(id_col).join(n, id_col, "left").join(first, id_col, "left")
    return out.withColumn("n_tables", F.coalesce("n_tables", F.lit(0))).withColumn("has_tables", F.col("n_tables") > 0)


def sheet_text(df: DataFrame, name: str, order: list[str], context: str = "", summary: str = "", block_rows: int = 1000) -> DataFrame:
    """(sheet, block, text): the sheet as text, in blocks of about ``block_rows`` lines of a Markdown
    table, ranges of ``order`` that Spark sorts and numbers; block 0 also holds the workbook's
    ``summary``, ``context``, columns and row count. The blocks in order, joined by newlines, are the text."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    n = df.count()
    blocks = max(1, -(-n // block_rows))
    dealt = df.select(F.struct(*order).alias("k"), line.alias("l")).repartitionByRange(blocks, "k").withColumn("p", F.spark_partition_id())
    own = dealt.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("k", "l"))).alias("r"))
    # one row a block: the window numbers blocks, not rows
    own = own.select((F.row_number().over(Window.orderBy("p")) - 1).alias("block"), F.array_join(F.transform("r", lambda x: x["l"]), "\n").alias("lines"))
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    start = (f"{summary}\n" if summary else "") + f"Sheet: {name}\n" + (f"{context}\n" if context else "") + "Columns: " + ", ".join(df.columns) + f"\nRows: {n}\n\n{head}"
    if not n:
        return df.sparkSession.createDataFrame([(name, 0, start)], "sheet string, block int, text string")
    text = F.when(F.col("block") == 0, F.concat(F.lit(start + "\n"), F.col("lines"))).otherwise(F.col("lines"))
    return own.select(F.lit(name).alias("sheet"), F.col("block").cast("int").alias("block"), text.alias("text"))


def workbook_summary(sheets: dict[str, DataFrame], most: int = 10) -> str:
    """One line a sheet: its name and first columns. Schemas suffice, so no row is read."""
    named = lambda df: ", ".join(df.columns[:most]) + (", ..." if len(df.columns) > most else "")
    return f"Workbook: {len(sheets)} sheets\n" + "\n".join(f"- {name}: {named(df)}" for name, df in sheets.items())


def resolve_sheet_source(
    spark: SparkSession,
    columns: list[str],
    sql: str | None = None,
    where: str | None = None,
    doc_tables: dict[str, DataFrame] | None = None,
    sources: tuple[str, ...] = (),
) -> tuple[str, DataFrame]:
    """(how, rows) of a planned sheet: the rows of ``sql`` if there are any, filtered by ``where``
    unless the query has a WHERE of its own; else the document table that an ``extract:<id>`` of
    ``sources`` names; else the first one with rows; else an empty table of ``columns``. (The first
    one with rows is found wherever the largest has rows, so no sizes are compared.)"""
    if sql:
        rows = guarded_select(spark, sql, None)[0]
        if rows is not None and not rows.isEmpty():
            return "sql", rows.where(where) if where and not re.search(r"(?i)where", sql) else rows
    filled = {}
    has_rows = lambda key: filled.setdefault(key, not doc_tables[key].isEmpty())
    for wanted in (s.removeprefix("extract:").lower() for s in sources if s.startswith("extract:")):
        for key in doc_tables or {}:
            if wanted in key.lower() and has_rows(key):
                return "extract", doc_tables[key]
    for key in doc_tables or {}:
        if has_rows(key):
            return "document", doc_tables[key]
    return "empty", spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def rows_to_strings(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``row_text``: ``Column: value`` parts of the filled cells."""
    part = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in df.columns]
    text = F.concat_ws(" | ", *part)
    return df.select(*keep, F.when(text == "", "(empty row)").otherwise(text).alias("row_text"))


def pivot_aggregate(df: DataFrame, group_by: list[str], aggregations: dict[str, str]) -> DataFrame:
    """One aggregate for each valid column, by the valid keys without nulls; unchanged if none is."""
    keys = [c for c in group_by if c in df.columns]
    known = {"sum": exact_sum, "mean": lambda c: exact_sum(c) / F.count(c), "count": F.count, "min": F.min, "max": F.max}
    valid = [known[a](F.col(c)).alias(c) for c, a in aggregations.items() if c in df.columns and a in known and c not in keys]
    if not keys or not valid:
        return df
    return df.dropna(subset=keys).groupBy(*keys).agg(*valid)


def arrange_sheet(df: DataFrame, planned: list[str], sort_by: str | None = None) -> DataFrame:
    """Planned columns first, extras after; sorted by ``[-]column`` where it exists."""
    name = (sort_by or "").lstrip("-")
    if name in df.columns:
        df = df.orderBy(F.col(name).desc_nulls_last() if sort_by.startswith("-") else F.col(name).asc_nulls_last())
    first = [c for c in planned if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def summary_metrics(sheets: dict[str, DataFrame], most: int = 5) -> DataFrame:
    """(sheet, metric, value): rows, and sum and mean of the first numeric columns."""
    parts = []
    for name, df in sheets.items():
        numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)][:most]
        made = {"Rows": F.count(F.lit(1)).cast("double")}
        for c in numeric:
            made |= {f"{c} sum": exact_sum(F.col(c)), f"{c} mean": F.round(exact_sum(F.col(c)) / F.count(c), 6)}
        wide = df.agg(*[v.alias(k) for k, v in made.items()]).where("Rows > 0")
        parts.append(wide.unpivot([], list(made), "metric", "value").select(F.lit(name).alias("sheet"), "metric", "value"))
    return reduce(DataFrame.unionByName, parts)


def add_columns(df: DataFrame, constants: dict | None = None, computed: dict[str, str] | None = None) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in (constants or {}).items()} | {k: F.expr(e) for k, e in (computed or {}).items()})


def label_rows(df: DataFrame, text_col: str, labeler, out: str = "label", budget: int = 8000) -> DataFrame:
    """Batch-label strings by ``labeler(list) -> list``: blanks are N/A, short replies are padded,
    a batch that fails is Error. A batch holds 20 to 300 rows, by the tokens of its first ones."""

    @F.pandas_udf("string")
    def run(batches):
        for s in batches:
            done = []
            text = s.fillna("").tolist()
            mean = max(1, sum(map(len, text[:20])) // max(1, 4 * len(text[:20])))
            size = min(300, max(20, budget // mean))
            for i in range(0, len(text), size):
                part = text[i : i + size]
                try:
                    got = list(labeler(part))
                except Exception:
                    got = ["Error"] * len(part)
                got = [str(g) for g in got[: len(part)]] + ["N/A"] * (len(part) - len(got))
                done += [g if t.strip() else "N/A" for g, t in zip(got, part, strict=True)]
            yield pd.Series(done, index=s.index, dtype=object)

    return df.withColumn(out, _iterator(run)(F.col(text_col)))


def keyword_labeler(batch: list[str]) -> list[str]:
    """The default labeler: questions, long texts and others."""
    return ["question" if "?" in s else "long" if len(s) > 200 else "other" for s in batch]


def _iterator(udf):
    from collections.abc import Iterator

    udf.func.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(udf.func, "string")


def merge_themes(batches: DataFrame, analysed: int | None = None, most: int = 3) -> DataFrame:
    """(theme, n, percent, examples) of batch themes (batch, theme, count, examples array)."""
    key = F.lower(F.trim("theme"))
    b = batches.withColumn("k", key)
    sums = b.groupBy("k").agg(F.sum("count").alias("n"), F.min_by(F.trim("theme"), "batch").alias("theme"))
    ex = b.select("k", "batch", F.posexplode("examples").alias("pos", "x")).groupBy("k", "x").agg(F.min(F.struct("batch", "pos")).alias("o"))
    ex = ex.withColumn("r", ranked(["k"], F.asc("o"), F.asc("x"))).where(F.col("r") <= most)
    ex = ex.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "x"))), lambda v: v["x"]).alias("examples"))
    out = sums.join(ex, "k", "left")
    if analysed is None:  # one row
        out = out.crossJoin(F.broadcast(sums.agg(F.sum("n").alias("_all"))))
    total = F.lit(analysed) if analysed is not None else F.col("_all")
    out = out.withColumn("percent", F.round(100 * F.col("n") / total, 1))
    return out.select("theme", "n", "percent", "examples")


def batch_rows(df: DataFrame, group_col: str, order_cols: list[str], size: int = 200, least: int = 100) -> DataFrame:
    """``batch``: each group in ceil(n/size) even batches, the last with the rest; one batch if small."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group_col))
    r = ranked([group_col], *map(F.col, order_cols)) - 1
    d = df.withColumn("_n", n).withColumn("_r", r).withColumn("_b", F.ceil(F.col("_n") / size))
    batch = F.when(F.col("_n") < least, 0).otherwise(F.least(F.expr("_r div (_n div _b)"), F.col("_b") - 1))
    return d.withColumn("batch", batch.cast("int")).drop("_n", "_r", "_b")


def batch_rows_by_tokens(
    df: DataFrame, group_col: str, order_cols: list[str], text_col: str, budget: int, overhead: int = 2000, sample: int = 20, least: int = 10, counter=count_tokens
) -> DataFrame:
    """``batch``: runs of as many rows of a group as fit ``budget`` less the prompt, by the mean
    tokens of the group's first ``sample`` rows; ``least`` rows at least."""
    d = df.withColumn("_r", ranked([group_col], *map(F.col, order_cols)) - 1)
    first = d.where(F.col("_r") < sample).groupBy(group_col)
    # the sample's rows stand in lines of their own
    mean = first.agg((counter(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(text_col).alias("t")))), lambda x: x["t"]), "\n")) / F.count(F.lit(1))).alias("_mean"))
    size = F.greatest(F.lit(least), F.floor(F.lit(float(budget - overhead)) / F.greatest(F.lit(1.0), F.col("_mean"))))
    return d.join(mean, group_col).withColumn("batch", F.floor(F.col("_r") / size).cast("int")).drop("_r", "_mean")


def parse_markdown_result(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, cells) after the first separator line; nothing without one."""
    lines = F.transform(F.split(text_col, "\n"), lambda x: F.trim(x))
    rule = F.transform(lines, lambda x: x.rlike(r"^\|[\s:|-]*-[\s:|-]*\|$"))
    each = df.select(id_col, lines.alias("_lines"), F.array_position(rule, True).alias("_rule")).where("_rule > 0")
    body = each.select(id_col, F.posexplode(F.expr("slice(_lines, cast(_rule as int) + 1, size(_lines))")).alias("row", "line"))
    cells = F.transform(F.split(F.expr("substring(line, 2, length(line) - 2)"), r"\|"), lambda c: F.trim(c))
    return body.where(F.col("line").rlike(r"^\|.*\|$")).select(id_col, "row", cells.alias("cells"))


def chart_series(df: DataFrame, x: str, ys: list[str]) -> DataFrame | None:
    """(x, series, value), or None if a column is missing."""
    if any(c not in df.columns for c in (x, *ys)):
        return None
    return df.select(F.col(x).cast("string").alias("x"), *[F.col(y).cast("double") for y in ys]).unpivot("x", ys, "series", "value")
