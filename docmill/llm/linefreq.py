"""Quality rules from cross-document line frequency.

Lines are normalised (ASCII lower case, digits to 0, runs of other ASCII non-letters to one
space), hashed, and counted in distinct documents per host; documents with equal texts count
once, as copies are for deduplication to judge. A line in more documents of its host than
the limit, max(``min_docs``, ``max_share`` of the host's distinct texts), is boilerplate and
is removed. A document is rejected if it fails the base rules or if it is depleted: under
``min_left`` of its words, or fewer than ``min_words``, are left after a removal.

Edge cases: a null text has no words; a null host is a host of its own; lines without a
letter or digit of any script are never counted or removed; repeated rows are judged alike;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm._common import cut, free_name, numbered, table

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
_DIGITS, _OTHER = re.compile(rb"[0-9]+"), re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def normal_line(line: bytes) -> bytes:
    return _OTHER.sub(b" ", _DIGITS.sub(b"0", line.lower())).strip()


def base_stats(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line hashes, words and number of each."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, repeat = len(words), 0
    if n > 3:
        known: dict = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
        triples = pairs[:-1] * len(known) + ids[2:]
        _, back, times = np.unique(triples, return_inverse=True, return_counts=True)
        twice = times[back] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeat = int(covered.sum())
    seen, dup, hashes, counts, numbers = set(), 0, [], [], []
    for number, line in enumerate(raw.split(b"\n")):
        held = len(line.split())
        if held:
            dup += line in seen
            seen.add(line)
            if normal := normal_line(line):
                hashes.append(xxhash.xxh64_intdigest(normal, 42))
                counts.append(held)
                numbers.append(number)
    lines = np.array(hashes, np.uint64).view(np.int64)
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat, lines, counts, numbers


def line_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = 20,
    max_share: float = 0.02,
    min_left: float = 0.3,
    min_words: int = 20,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Base statistics of each document, n_removed_words, removed_lines (numbers from 0, sorted),
    base_failed, kept, and the columns ``keys`` of its row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            made = list(zip(*map(base_stats, b["_text"]), strict=True)) or [[]] * 8
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words", "line_at")
            key = [xxhash.xxh3_128_hexdigest((t or "").encode("utf-8", "surrogatepass")) for t in b["_text"]]
            yield pd.DataFrame({"_id": b["_id"], "host": b["host"], "same": key} | {k: b[k] for k in keys} | dict(zip(names, made, strict=True)))

    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host"),
        F.col(text_col).alias("_text"),
        *keys,
    )
    kept_keys = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    stats = rows.mapInPandas(
        run,
        f"_id {kind}, host string, same string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
        " n_repeat_words long, lines array<long>, line_words array<int>, line_at array<int>"
        + kept_keys,
    )
    stats = cut(stats.withColumn("row", F.monotonically_increasing_id()), "stats")
    # one row speaks for all equal texts of a host; the minimum of a hash-free key is decided map-side first
    speaks = stats.groupBy("host", "same").agg(F.min("row").alias("row"))
    voices = stats.join(speaks.select("row"), "row", "left_semi").select("host", F.explode(F.array_distinct("lines")).alias("line"))
    limits = speaks.groupBy("host").agg(
        F.greatest(F.lit(float(min_docs)), max_share * F.count(F.lit(1))).alias("most")
    )
    counted = voices.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > min_docs)
    frequent = cut(counted.join(limits, "host").where("docs > most").select("host", "line"), "frequent")
    each = stats.select("row", "host", F.explode(F.arrays_zip("lines", "line_words", "line_at")).alias("l")).select(
        "row", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("held"), F.col("l.line_at").alias("at")
    )
    removed = each.join(frequent, ["host", "line"]).groupBy("row")
    removed = removed.agg(F.sum("held").alias("n_removed_words"), F.sort_array(F.collect_list("at")).alias("removed_lines"))
    out = stats.drop("lines", "line_words", "line_at", "same").join(removed, "row", "left")
    gone = F.coalesce("n_removed_words", F.lit(0))
    left = F.col("n_words") - gone
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (gone > 0) & ((left < min_left * F.col("n_words")) | (left < min_words))
    return out.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        gone.alias("n_removed_words"), F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), *keys,
    )


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, their texts without the lines above the limits."""
    rows, row = numbered(docs)
    gone = free_name(rows, "_removed")
    judged = line_quality(rows, id_col, text_col, keys=(row,), **options).where("kept").select(row, F.col("removed_lines").alias(gone))
    left = F.filter(F.split(text_col, "\n"), lambda _, i: ~F.array_contains(gone, i))
    text = F.when(F.size(gone) > 0, F.array_join(left, "\n")).otherwise(F.col(text_col))
    return rows.join(judged, row).withColumn(text_col, text).select(*docs.columns)


def op4_line_frequency(spark, sf_dir):
    return line_quality(table(spark, sf_dir, "documents")).drop("removed_lines")
