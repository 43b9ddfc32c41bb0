"""Chat logs, operational tables and model output."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docmill.functions.words import ranked


def recent_history(chats: DataFrame, thread_col: str, turn_col: str, turns: int = 2) -> DataFrame:
    r = ranked([thread_col], F.desc(turn_col))
    return chats.withColumn("_r", r).where(F.col("_r") <= 2 * turns).drop("_r")


def page_chats(chats: DataFrame, thread_col: str, turn_col: str, skip: int = 0, limit: int = 50) -> DataFrame:
    total = F.count(F.lit(1)).over(Window.partitionBy(thread_col))
    c = chats.withColumn("total", total).withColumn("idx", ranked([thread_col], F.asc(turn_col)) - 1)
    return c.where((F.col("idx") >= skip) & (F.col("idx") < skip + limit))


def delete_chats(chats: DataFrame, deletes: DataFrame, thread_col: str, turn_col: str) -> DataFrame:
    """Messages whose index in their thread is not in ``deletes`` (thread, idx), numbered anew."""
    c = chats.withColumn("idx", ranked([thread_col], F.asc(turn_col)) - 1)
    left = c.join(deletes.select(thread_col, "idx").distinct(), [thread_col, "idx"], "left_anti")
    return left.withColumn("idx", ranked([thread_col], F.asc(turn_col)) - 1)


def ignored_deletes(chats: DataFrame, deletes: DataFrame, thread_col: str) -> DataFrame:
    n = chats.groupBy(thread_col).agg(F.count(F.lit(1)).alias("n"))
    return deletes.join(n, thread_col, "left").where((F.col("idx") < 0) | (F.col("idx") >= F.coalesce("n", F.lit(0)))).select(thread_col, "idx")


def selected_instructions(threads: DataFrame, thread_col: str, array_col: str) -> DataFrame:
    return threads.select(thread_col, F.transform(F.filter(array_col, lambda x: x["selected"]), lambda x: x["text"]).alias("texts"))


def list_exports(records: DataFrame, files: DataFrame) -> DataFrame:
    done = records.where(F.col("_status").isNull()) if "_status" in records.columns else records
    return done.join(files.select("file_name").distinct(), "file_name", "left_semi").orderBy(F.desc("created_at"), "file_name")


def thread_profile(docs: DataFrame, thread_col: str, name_col: str, sheets=("xls", "xlsx", "csv")) -> DataFrame:
    is_sheet = F.lower(F.regexp_extract(name_col, r"\.([^.]+)$", 1)).isin(*sheets)
    return docs.groupBy(thread_col).agg(F.bool_or(is_sheet).alias("has_sheets"), F.bool_and(is_sheet).alias("only_sheets"))


def export_transcripts(
    chats: DataFrame, thread_col: str, turn_col: str, role_col: str, text_col: str, time_col: str | None = None, sources_col: str | None = None, block: int = 1000
) -> DataFrame:
    """(thread, block, transcript): Markdown in turn order, with each message's time and, for answers,
    its sources (array of struct<title, page_no>). A block holds ``block`` turns, so a thread of any
    length is many rows; in order and put together they are the transcript."""
    role = F.when(F.col(role_col) == "user", "User").otherwise("Assistant")
    time = F.concat(F.lit(" ("), F.coalesce(F.date_format(time_col, "yyyy-MM-dd HH:mm:ss"), F.lit("")), F.lit(")")) if time_col else F.lit("")
    entry = F.concat(F.lit("## "), role, time, F.lit("\n\n"), F.coalesce(text_col, F.lit("")), F.lit("\n\n"))
    if sources_col:
        each = lambda x: F.concat(F.lit("- **"), F.coalesce(x["title"], F.lit("Untitled")), F.lit("** (Page "), F.coalesce(x["page_no"].cast("string"), F.lit("?")), F.lit(")\n"))
        shown = F.concat(F.lit("### Sources Used\n"), F.array_join(F.transform(sources_col, each), ""), F.lit("\n"))
        entry = F.concat(entry, F.when((F.col(role_col) != "user") & (F.size(sources_col) > 0), shown).otherwise(""))
    own = F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("t"), F.concat(entry, F.lit("---\n\n")).alias("e"))))
    part = F.floor(F.col(turn_col) / block).alias("block")
    return chats.groupBy(thread_col, part).agg(F.array_join(F.transform(own, lambda x: x["e"]), "").alias("transcript"))


#: Action names that mean another one.
ACTIONS = {
    "fail": "failure", "error": "failure", "search": "web_search", "google": "web_search", "web": "web_search", "query": "sql_query",
    "database": "sql_query", "sql": "sql_query", "summarize": "document_summarizer", "summary": "document_summarizer", "excel": "excel_create",
    "spreadsheet": "excel_create", "export": "excel_create", "download_excel": "excel_create", "create_excel": "excel_create",
}


def normalize_actions(df: DataFrame, col: str, out: str = "action") -> DataFrame:
    low = F.lower(F.trim(col))
    known = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return df.withColumn(out, F.coalesce(F.try_element_at(known, low), low))


def normalize_answers(df: DataFrame, col: str, out: str) -> DataFrame:
    r"""Doubly escaped newlines, tabs, quotes and slashes undone; three or more newlines to two."""
    c = F.regexp_replace(F.coalesce(col, F.lit("")), r"\\\\n|\\n", "\n")
    c = F.regexp_replace(c, r"\\\\t|\\t", "\t")
    c = F.regexp_replace(F.regexp_replace(c, r'\\+"', '"'), r"\\+/", "/")
    return df.withColumn(out, F.regexp_replace(c, r"\n{3,}", "\n\n"))


_MARK = re.compile(r'[{}"\\]')


def json_objects(text: str):
    """(start, end) of the outermost balanced objects, in one walk with a stack of open braces: one
    that is never closed is passed over, and what it holds counts by itself. Quotes are tried from
    the first brace on; an odd one there ends at the line."""
    opened: list[int] = []
    spans: list[tuple[int, int]] = []
    inside, skip = False, -1
    for m in _MARK.finditer(text):
        c, at = m[0], m.start()
        if at == skip:
            continue
        if inside and c == "\\":
            skip = at + 1
        elif c == '"' and opened:
            inside = not inside
        elif not inside and c == "{":
            opened.append(at)
        elif not inside and c == "}" and opened:
            start = opened.pop()
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, at + 1))
    return spans


def _escaped(raw: str) -> str:
    """Control characters inside strings as escapes."""
    parts = re.split(r'((?<!\\)(?:\\\\)*")', raw)
    inside, out = False, []
    for p in parts:
        out.append(p.replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") if inside and not p.endswith('"') else p)
        inside ^= p.endswith('"')
    return "".join(out)


def outermost_json(raw: str | None, fields: tuple[str, ...] = ()) -> str | None:
    """The first object of a noisy reply that parses, control characters in strings escaped; one
    that has a field of ``fields`` comes before all others. Time grows with the text."""
    text = re.sub(r"(?is)<(think|thinking|reasoning)>.*?(</\1>|\Z)", "", raw or "")
    text = re.sub(r"[ ​‌‍﻿]", " ", re.sub(r"```(?:json)?", "", text))
    first = None
    for start, end in json_objects(text):
        found = _escaped(text[start:end])
        try:
            held = json.loads(found)
        except ValueError:
            continue
        if not fields or any(f in held for f in fields):
            return found
        first = first or found
    return first


def parse_responses(df: DataFrame, raw_col: str, schema: str, answer_field: str = "answer", longest: int = 8000) -> DataFrame:
    """``parsed`` (a struct of ``schema``) and ``error``; plain replies become the answer field."""

    fields = tuple(f.name for f in StructType.fromDDL(schema))

    @F.pandas_udf("string")
    def scan(s: pd.Series) -> pd.Series:
        return s.map(lambda raw: outermost_json(raw, fields))

    found = df.withColumn("_json", scan(raw_col))
    plain = F.to_json(F.struct(F.substring(F.trim(raw_col), 1, longest).alias(answer_field)))
    found = found.withColumn("error", F.when(F.length(F.trim(F.coalesce(raw_col, F.lit("")))) == 0, "empty").when(F.col("_json").isNull(), "no json"))
    return found.withColumn("parsed", F.from_json(F.coalesce("_json", plain), schema)).drop("_json")
