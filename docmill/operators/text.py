"""Text normalisation, chunking and selection."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.words import stop_words

BLANKS = r"[ ​‌‍﻿]+"
SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")


def clean_cells(df: DataFrame) -> DataFrame:
    """String columns with invisible blanks and newlines as spaces, trimmed."""
    fixed = {
        f.name: F.trim(F.regexp_replace(F.regexp_replace(F.col(f.name), BLANKS, " "), r"[\n\r]", " "))
        for f in df.schema
        if isinstance(f.dataType, T.StringType)
    }
    return df.withColumns(fixed)


def word_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 10_000, whole_up_to: int = 11_000) -> DataFrame:
    """(id, chunk, n_words, text): one chunk up to ``whole_up_to`` words, else runs of ``size``."""
    words = df.select(id_col, F.filter(F.split(F.coalesce(text_col, F.lit("")), r"\s+"), lambda w: w != "").alias("w"))
    words = words.where(F.size("w") > 0)
    step = F.when(F.size("w") <= whole_up_to, F.size("w")).otherwise(F.lit(size))
    at = F.sequence(F.lit(0), ((F.size("w") - 1) / step).cast("int"))
    part = words.withColumn("step", step).select(id_col, "w", "step", F.explode(at).alias("chunk"))
    own = F.slice("w", F.col("chunk") * F.col("step") + 1, F.col("step"))
    return part.select(id_col, "chunk", F.size(own).alias("n_words"), F.array_join(own, " ").alias("text"))


def select_content(df: DataFrame, id_col: str, text_col: str, summary_col: str, limit: int = 8000) -> DataFrame:
    """(id, how, content): the text if short, else its summary, else its first words."""
    words = F.filter(F.split(F.coalesce(text_col, F.lit("")), r"\s+"), lambda w: w != "")
    short, summary = F.size(words) < limit, F.length(F.trim(F.coalesce(summary_col, F.lit("")))) > 0
    return df.select(
        id_col,
        F.when(short, "full").when(summary, "summary").otherwise("cut").alias("how"),
        F.when(short, F.col(text_col)).when(summary, F.col(summary_col)).otherwise(F.array_join(F.slice(words, 1, limit), " ")).alias("content"),
    )


def term_frequencies(df: DataFrame, text_col: str, max_words: int = 100, extra_stops: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent words (word, n) without stop words; ties by word."""
    clean = F.lower(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"\\u[0-9a-fA-F]{4}", " "))
    word = df.select(F.explode(F.split(F.regexp_replace(clean, r"[^\p{L}]+", " "), " ")).alias("word"))
    stops = set(stop_words()) | set(extra_stops) | {"n", "u", "r", ""}
    kept = word.where(~F.col("word").isin(*sorted(stops)) & (F.length("word") > 1))
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(max_words)


def extract_terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, acronym, expansion) of ``ACRONYM (expansion)``; the last definition wins."""
    pattern = F.lit(r"\b([A-Z]{2,})\s*\(([^)]+)\)")
    pairs = F.arrays_zip(F.regexp_extract_all(text_col, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(text_col, pattern, F.lit(2)).alias("e"))
    each = df.select(id_col, F.posexplode(pairs).alias("pos", "p")).select(id_col, "pos", F.col("p.a").alias("acronym"), F.trim("p.e").alias("expansion"))
    return each.where(F.length("expansion") > 5).groupBy(id_col, "acronym").agg(F.max_by("expansion", "pos").alias("expansion"))


def cut_repetition(df: DataFrame, id_col: str, text_col: str, pattern: str, times: int = 2) -> DataFrame:
    """(id, n_lines, text) up to the line whose label ``times`` earlier lines already had. All of it
    happens in the row: sorted with their places, equal labels stand together."""
    lines = df.select(id_col, F.split(F.coalesce(text_col, F.lit("")), "\n").alias("lines"))
    labels = lambda line: F.array_distinct(F.filter(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), lambda x: x != ""))
    each = F.flatten(F.transform("lines", lambda line, i: F.transform(labels(line), lambda x: F.struct(x.alias("label"), i.alias("pos")))))
    each = lines.select(id_col, "lines", F.array_sort(each).alias("each"))
    again = F.transform("each", lambda x, k: F.when((k >= times) & (F.get("each", k - times)["label"] == x["label"]), x["pos"]))
    kept = each.select(id_col, F.slice("lines", F.lit(1), F.coalesce(F.array_min(again), F.size("lines"))).alias("lines"))
    return kept.where(F.size("lines") > 0).select(id_col, F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", "\n").alias("text"))


def thread_summaries(df: DataFrame, thread_col: str, id_col: str, title_col: str, summary_col: str, block_chars: int = 1_000_000) -> DataFrame:
    """(thread, block, n_summaries, summaries): ``title: summary`` in document order; threads with none
    too, as one empty block. A block ends where the next entry would begin beyond ``block_chars``
    characters times its number + 1, so a thread of any size is no single value; n_summaries counts the
    thread's."""
    has = F.length(F.trim(F.coalesce(summary_col, F.lit("")))) > 0
    entry = F.concat_ws(": ", title_col, summary_col)
    all_ = df.groupBy(thread_col).agg(F.count(F.when(has, 1)).alias("n_summaries"))
    ahead = Window.partitionBy(thread_col).orderBy(id_col, "_entry").rowsBetween(Window.unboundedPreceding, -1)
    each = df.where(has).select(thread_col, id_col, entry.alias("_entry"))
    each = each.withColumn("block", (F.coalesce(F.sum(F.length("_entry") + 1).over(ahead), F.lit(0)) / block_chars).cast("int"))
    own = F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col("_entry").alias("s"))))
    blocks = each.groupBy(thread_col, "block").agg(F.array_join(F.transform(own, lambda x: x["s"]), "\n").alias("summaries"))
    same = F.col(f"a.{thread_col}").eqNullSafe(F.col(f"b.{thread_col}"))
    out = all_.alias("a").join(blocks.alias("b"), same, "left")
    return out.select(f"a.{thread_col}", F.coalesce("block", F.lit(0)).alias("block"), "n_summaries", F.coalesce("summaries", F.lit("")).alias("summaries"))


def split_recursive(text: str, size: int, overlap: int, separators=SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that occurs; each
    starts with up to ``overlap`` characters of the piece before."""
    if len(text) <= size:  # nothing to cut
        return [whole] if (whole := text.strip()) else []
    sep = next((s for s in separators if not s or s in text), "")
    finer = separators[separators.index(sep) + 1 :] if sep else ()
    parts = text.split(sep) if sep else ()
    raw = [*(p + sep for p in parts[:-1]), parts[-1]] if sep else text
    out: list[str] = []
    held: deque[str] = deque()
    total = 0

    def close():
        if joined := "".join(held).strip():
            out.append(joined)

    for part in raw:
        if len(part) > size and finer:
            close()
            held.clear()
            total = 0
            out += split_recursive(part, size, overlap, finer)
            continue
        if held and total + len(part) > size:
            close()
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.popleft())
        if part:
            held.append(part)
            total += len(part)
    close()
    return out


def chunk_hierarchical(df: DataFrame, id_col: str, text_col: str, parent: tuple[int, int] = (1500, 150), child: tuple[int, int] = (500, 75)) -> DataFrame:
    """(id, parent_idx, child_idx, parent_text, text): overlapping parents, each cut into children."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for i, t in zip(b["_id"], b["_text"], strict=True):
                for p, big in enumerate(split_recursive(t or "", *parent)):
                    rows += [(i, p, c, big, small) for c, small in enumerate(split_recursive(big, *child))]
            if rows:
                yield pd.DataFrame(rows, columns=["_id", "parent_idx", "child_idx", "parent_text", "text"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = rows.mapInPandas(run, f"_id {kind}, parent_idx int, child_idx int, parent_text string, text string")
    return out.withColumnRenamed("_id", id_col)


@F.udtf(returnType="parent_idx int, child_idx int, chunk_index int, parent_text string, before string, text string, after string", useArrow=True)
class PageChunks:
    """The children of one text in order, each with its neighbours."""

    def eval(self, text: str, parent: int, parent_overlap: int, child: int, child_overlap: int):
        flat = [
            (p, c, big, small)
            for p, big in enumerate(split_recursive(text or "", parent, parent_overlap))
            for c, small in enumerate(split_recursive(big, child, child_overlap))
        ]
        for k, (p, c, big, small) in enumerate(flat):
            yield p, c, k, big, flat[k - 1][3] if k else None, small, flat[k + 1][3] if k + 1 < len(flat) else None


def chunk_pages(df: DataFrame, text_col: str, parent: tuple[int, int] = (1500, 150), child: tuple[int, int] = (500, 75)) -> DataFrame:
    """``df`` without ``text_col``, a row for each child chunk: parent_idx, child_idx, chunk_index
    (flat in the text), parent_text, before, text, after. A lateral join carries the other columns past Python."""
    made = PageChunks(F.col("_page_text").outer(), *[F.lit(n) for n in (*parent, *child)])
    rows = df.withColumnRenamed(text_col, "_page_text").lateralJoin(made)
    return rows.drop("_page_text")


def fit_token_budget(df: DataFrame, thread_col: str, id_col: str, text_col: str, max_tokens: int, offset: int = 0) -> DataFrame:
    """(thread, id, text): all texts of a thread trimmed at the end, in rounds, until their tokens
    (four characters each) fit ``max_tokens - offset - 1000``. A round is one length per row,
    so whole rounds are folded over each thread's histogram of lengths."""
    budget = max(0, max_tokens - offset - 1000)
    sized = df.select(thread_col, id_col, F.coalesce(text_col, F.lit("")).alias("text"), F.length(F.coalesce(text_col, F.lit(""))).alias("len"))
    hist = sized.groupBy(thread_col, "len").agg(F.count(F.lit(1)).alias("n")).groupBy(thread_col)
    hist = hist.agg(F.collect_list(F.struct("len", "n")).alias("h"))

    @F.pandas_udf("array<int>")
    def rounds(h: pd.Series) -> pd.Series:
        out = []
        for rows in h:
            left, cuts = [(r["len"], r["n"]) for r in rows], []
            while (total := sum(-(-x // 4) * n for x, n in left)) > budget and any(x > 10 for x, _ in left):
                cut = max(10, -(-(total - budget) * 4 // sum(n for _, n in left)))
                cuts.append(cut)
                left = [(max(0, x - cut) if x > 10 else x, n) for x, n in left]
            out.append(cuts)
        return pd.Series(out)

    cuts = hist.select(thread_col, rounds("h").alias("cuts"))
    left = F.aggregate("cuts", F.col("len"), lambda a, c: F.when(a > 10, F.greatest(F.lit(0), a - c)).otherwise(a))
    return sized.join(cuts, thread_col).select(thread_col, id_col, F.substring(F.col("text"), F.lit(1), left).alias("text"))


def paginate_text(df: DataFrame, id_col: str, text_col: str, whole: int = 5000, page: int = 3000, separator: str = "\n\n") -> DataFrame:
    """(id, page_no, text): one page up to ``whole`` characters, else paragraphs packed greedily."""
    parts = F.filter(F.split(F.coalesce(text_col, F.lit("")), separator), lambda p: F.trim(p) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(s, p):
        fits = (s["held"] == "") | (F.length(s["held"]) + F.length(p) + len(separator) <= page)
        grown = F.when(s["held"] == "", p).otherwise(F.concat(s["held"], F.lit(separator), p))
        return F.struct(
            F.when(fits, s["done"]).otherwise(F.array_append(s["done"], s["held"])).alias("done"), F.when(fits, grown).otherwise(p).alias("held")
        )

    packed = F.aggregate(parts, start, step, lambda s: F.when(s["held"] == "", s["done"]).otherwise(F.array_append(s["done"], s["held"])))
    pages = F.when(F.length(F.coalesce(text_col, F.lit(""))) <= whole, F.array(F.coalesce(text_col, F.lit("")))).otherwise(packed)
    return df.select(id_col, F.posexplode(pages).alias("p", "text")).select(id_col, (F.col("p") + 1).alias("page_no"), "text")


