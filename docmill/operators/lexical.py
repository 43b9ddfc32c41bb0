"""A stored, incrementally kept BM25 index.

Chunks are dealt into parts by a hash of their ids. A part holds its postings (thread, term, chunk_id,
tf, dl), sorted by term and thread, and its share of the statistics: ``terms`` (thread, term, df) and
``sizes`` (thread, n, total). A change writes only the parts whose chunks it touches; what a query
weighs is the sum of the parts' shares. ``threads`` (thread, n_chunks, avgdl, mean), in the part 0, is
made anew for the threads that changed. Weights are not stored: they depend on all chunks of a thread."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.words import tokens
from docmill.sources.versions import Versions


#: Terms of threads up to which every task is told them all, so that only the postings asked for go on.
TOLD = 1_000_000


def term_counts(chunks: DataFrame, thread_col: str, id_col: str, text_col: str) -> DataFrame:
    """(thread, chunk_id, term, tf, dl): the terms of each chunk and how often it has them. A chunk's
    words are counted where it lies, so nothing is shuffled. A chunk without terms has one row without a term."""
    own = chunks.select(F.col(thread_col).alias("thread"), F.col(id_col).alias("chunk_id"), tokens(text_col).alias("words"))
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("thread", "chunk_id"))

    def count(batches):
        for b in batches:
            words = b.column("words")
            sizes = pa.compute.list_value_length(words).to_numpy(zero_copy_only=False)
            codes = words.flatten().dictionary_encode()
            row = np.repeat(np.arange(b.num_rows, dtype=np.int64), sizes)
            key, tf = np.unique(row * max(1, len(codes.dictionary)) + codes.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row, code = np.divmod(key, max(1, len(codes.dictionary)))
            none = np.flatnonzero(sizes == 0)
            at = pa.array(np.concatenate([row, none]))
            term = pa.concat_arrays([codes.dictionary.take(pa.array(code)), pa.nulls(len(none), codes.dictionary.type)])
            counts = np.concatenate([tf, np.zeros(len(none), np.int64)])
            columns = [b.column("thread").take(at), b.column("chunk_id").take(at), term, pa.array(counts), pa.array(sizes.astype(np.int64)).take(at)]
            yield pa.RecordBatch.from_arrays(columns, ["thread", "chunk_id", "term", "tf", "dl"])

    return own.mapInArrow(count, f"{kinds}, term string, tf long, dl long")


def _thread_facts(sizes: DataFrame, terms: DataFrame) -> DataFrame:
    """(thread, n_chunks, avgdl, mean): equal document frequencies have equal weights, so the mean is taken over their counts."""
    n = sizes.groupBy("thread").agg(F.sum("n").alias("n_chunks"), (F.sum("total") / F.sum("n")).alias("avgdl"))
    df = terms.groupBy("thread", "term").agg(F.sum("df").alias("df")).groupBy("thread", "df").agg(F.count(F.lit(1)).alias("k"))
    idf = (F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).cast("decimal(18,10)")
    df = df.join(n, "thread").groupBy("thread").agg((F.sum(idf * F.col("k").cast("decimal(18,0)")).cast("double") / F.sum("k")).alias("mean"))
    return n.join(df, "thread", "left")


def _runs(postings: DataFrame) -> DataFrame:
    """(thread, term, df, part): the lengths of the runs of equal terms in stored, sorted postings. A run that is
    read in two pieces is two rows, which whoever reads them sums; nothing is shuffled."""
    own = postings.select("thread", "term", "part")

    def count(batches):
        for b in batches:
            if not b.num_rows:
                continue
            codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in (b.column(k) for k in ("thread", "term", "part"))]
            new = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)]))
            n = np.diff(np.append(new, b.num_rows)).astype(np.int64)
            at = pa.array(new)
            yield pa.RecordBatch.from_arrays([b.column("thread").take(at), b.column("term").take(at), pa.array(n), b.column("part").take(at)], ["thread", "term", "df", "part"])

    return own.mapInArrow(count, f"thread {own.schema['thread'].dataType.simpleString()}, term string, df long, part int")


def _publish(store: Versions, postings: DataFrame, version: int, parts: list[int] | None, touched: DataFrame | None, dealt: bool = False) -> None:
    """Write ``postings`` (with part), their statistics, and the facts of the ``touched`` threads (None: of all).
    ``dealt``: a part's rows are in one partition already."""
    held = store.manifest()
    rows = (postings if dealt else postings.repartition("part")).sortWithinPartitions("part", "term", "thread")
    wrote = {"postings": store.write("postings", rows, version)}
    new = store.spark.read.parquet(f"{store.base}/postings/version={version}").where("chunk_id is not null") if wrote["postings"] else postings
    wrote["terms"] = store.write("terms", _runs(new.where("term is not null")), version)
    each = new.groupBy("part", "thread", "chunk_id").agg(F.max("dl").alias("dl")).groupBy("part", "thread").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"))
    wrote["sizes"] = store.write("sizes", each, version)
    now = {t: ({p: v for p, v in held.get(t, {}).items() if parts is not None and p not in parts} | wrote[t]) for t in wrote}
    read = lambda t: store.spark.read.option("basePath", f"{store.base}/{t}").parquet(*[f"{store.base}/{t}/version={v}/part={p}" for p, v in sorted(now[t].items())]) if now[t] else None
    sizes, terms = read("sizes"), read("terms")
    if sizes is not None and terms is not None:
        if touched is not None:
            facts = _thread_facts(sizes.join(touched, "thread", "left_semi"), terms.join(touched, "thread", "left_semi"))
            old = store.read("threads")
            facts = facts if old is None else facts.unionByName(old.drop("part").join(touched, "thread", "left_anti"))
        else:
            facts = _thread_facts(sizes, terms)
        wrote["threads"] = store.write("threads", facts.withColumn("part", F.lit(0)), version)
    store.switch(version, now | {"threads": wrote.get("threads", {})})
    store.clean()


def _part(parts: int):
    return F.pmod(F.xxhash64("thread", "chunk_id"), F.lit(parts)).cast("int")


def write_index(store: Versions, chunks: DataFrame, thread_col: str, id_col: str, text_col: str, parts: int = 64) -> None:
    """A new version of the index that holds ``chunks`` and nothing else. The chunks are dealt, which are fewer and
    smaller than their postings."""
    version = (store.versions() or [-1])[-1] + 1
    own = chunks.select(F.col(thread_col).alias("thread"), F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text"))
    counted = term_counts(own.repartitionById(parts, _part(parts)), "thread", "chunk_id", "text")
    _publish(store, counted.withColumn("part", _part(parts)), version, None, None, dealt=True)


def update_index(store: Versions, changed: DataFrame, removed: DataFrame | None, thread_col: str, id_col: str, text_col: str, parts: int = 64) -> None:
    """A new version in which ``changed`` chunks replace those of their ids or come in, and ``removed``
    ones (with the columns of thread and id) go. Only the parts of these chunks are read and written."""
    version = (store.versions() or [-1])[-1] + 1
    ids = changed.select(F.col(thread_col).alias("thread"), F.col(id_col).alias("chunk_id"))
    gone = ids if removed is None else ids.union(removed.select(thread_col, id_col))
    gone = gone.distinct().withColumn("part", _part(parts))
    touched = sorted(r["part"] for r in gone.select("part").distinct().collect())  # at most ``parts`` numbers
    new = term_counts(changed, thread_col, id_col, text_col).withColumn("part", _part(parts))
    old = store.read("postings", touched)
    if old is not None:
        new = old.join(gone, ["part", "thread", "chunk_id"], "left_anti").select(*new.columns).unionByName(new)
    _publish(store, new, version, touched, gone.select("thread").distinct())


def postings(store: Versions, asked: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(thread, term, chunk_id, weight) of the ``asked`` terms (term): the Okapi weights of the stored
    index, a negative idf as ``epsilon`` times its thread's mean. The chunks themselves are not read."""
    asked = asked.select("term").distinct()
    facts = store.read("threads").drop("part")
    df = store.read("terms").join(asked, "term", "left_semi").groupBy("thread", "term").agg(F.sum("df").alias("df")).join(facts, "thread")
    idf = F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = df.select("thread", "term", "avgdl", F.when(idf < 0, F.lit(epsilon) * F.col("mean")).otherwise(idf).alias("idf"))
    own = store.read("postings").where("term is not null").join(F.broadcast(df) if df.count() <= TOLD else df, ["thread", "term"])
    norm = F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    return own.select("thread", "term", "chunk_id", (F.col("idf") * F.col("tf") * F.lit(k1 + 1.0) / norm).alias("weight"))
