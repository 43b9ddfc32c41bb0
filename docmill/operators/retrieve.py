"""Retrieval for tables of queries: BM25, vectors, fusion, gates, re-ranking, packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from docmill.functions.words import exact_sum, ranked, tokens


def query_terms(queries: DataFrame, text_col: str) -> DataFrame:
    """The distinct terms (term) of all queries."""
    return queries.select(F.explode(tokens(text_col)).alias("term")).distinct()


def bm25_index(
    chunks: DataFrame, thread_col: str, id_col: str, text_col: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, terms: DataFrame | None = None
) -> DataFrame:
    """Postings (thread, term, id, weight): each term's Okapi weight in each chunk, statistics per
    thread; a negative idf becomes ``epsilon`` times the thread's mean idf. With ``terms`` only
    their postings are weighed; the statistics are those of all terms either way."""
    own = chunks.select(F.col(thread_col).alias("thread"), F.col(id_col).alias("chunk_id"), tokens(text_col).alias("words"))
    sizes = own.groupBy("thread").agg(F.count(F.lit(1)).alias("n_chunks"), (F.sum(F.size("words")) / F.count(F.lit(1))).alias("avgdl"))
    df = own.select("thread", F.explode(F.array_distinct("words")).alias("term")).groupBy("thread", "term").agg(F.count(F.lit(1)).alias("df"))
    df = df.join(sizes, "thread").withColumn("idf", F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.groupBy("thread").agg((F.sum(F.col("idf").cast("decimal(38,10)")).cast("double") / F.count(F.lit(1))).alias("mean"))
    asked = df if terms is None else df.join(terms, "term", "left_semi")
    idf = asked.join(mean, "thread").select("thread", "term", "avgdl", F.when(F.col("idf") < 0, F.lit(epsilon) * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    word = own.select("thread", "chunk_id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    if terms is not None:
        word = word.join(terms, "term", "left_semi")
    tf = word.groupBy("thread", "chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    norm = F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    full = tf.join(idf, ["thread", "term"])
    return full.select("thread", "term", "chunk_id", (F.col("idf") * F.col("tf") * F.lit(k1 + 1.0) / norm).alias("weight"))


def bm25_topk(postings: DataFrame, queries: DataFrame, query_id: str, text_col: str, top_k: int = 20) -> DataFrame:
    """(query_id, thread, chunk_id, rank, score): the best ``top_k`` of each thread, positives only."""
    term = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(text_col)).alias("term"))
    term = term.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = term.limit(ASKED + 1).collect()
    if len(asked) > ASKED:
        hit = postings.join(term, "term").groupBy("query_id", "thread", "chunk_id")
        total = hit.agg(F.sum(F.rint(F.col("weight") * F.col("times") * 1e10).cast("long")).alias("total"))
    else:
        total = best_totals(postings, asked, term.schema["query_id"], top_k)
    scored = total.withColumn("score", F.round(F.col("total").cast("double") / F.lit(1e10), 6)).drop("total")
    top = scored.withColumn("rank", ranked(["query_id", "thread"], F.desc("score"), F.asc("chunk_id"))).where(F.col("rank") <= top_k)
    return top.where("score > 0").select("query_id", "thread", "chunk_id", "score", "rank")


#: Distinct words of all queries together up to which every task is told them all.
ASKED = 200_000
#: Scores of a task that wait to be compared, and postings that are scored at a time.
WAITING, AT_A_TIME = 400_000, 20_000


def best_totals(postings: DataFrame, asked: list, id_field: StructField, top_k: int) -> DataFrame:
    """(query_id, thread, chunk_id, total): totals in 1e-10 of the ``asked`` rows (query_id, term, times), of each query and thread no
    less than the best ``top_k``. A chunk's postings meet in one task, which sums them for every query and hands
    on the best of its chunks, so what is shuffled grows with the postings and not with queries times chunks."""
    spark = postings.sparkSession
    ids = list(dict.fromkeys(r["query_id"] for r in asked))
    number = {q: k for k, q in enumerate(ids)}
    of_term: dict[str, list] = {}
    for r in asked:
        of_term.setdefault(r["term"], []).append((number[r["query_id"]], r["times"]))
    place = {w: k for k, w in enumerate(of_term)}
    ends = np.concatenate([[0], np.cumsum([len(v) for v in of_term.values()])]).astype(np.int64)
    pairs = np.array([x for v in of_term.values() for x in v], np.int64).reshape(-1, 2)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kinds = {c: postings.schema[c].dataType.simpleString() for c in ("thread", "chunk_id")}
    told = spark.sparkContext.broadcast((place, ends, pairs))

    def totals(b: pa.RecordBatch):
        """Of the postings of whole chunks: places of the chunks' first rows, numbers of queries, totals."""
        place, ends, pairs = told.value
        words = b.column("term").dictionary_encode()
        code = np.array([place.get(w, -1) for w in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()]
        mark = b.column("_mark").to_numpy()
        new = np.concatenate([[True], mark[1:] != mark[:-1]])
        row = np.flatnonzero(code >= 0)
        begin, count = ends[code[row]], ends[code[row] + 1] - ends[code[row]]
        at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        row = np.repeat(row, count)
        value = np.rint(b.column("weight").to_numpy()[row] * pairs[at, 1] * 1e10).astype(np.int64)
        key = (np.cumsum(new) - 1)[row] * len(ids) + pairs[at, 0]
        order = np.argsort(key, kind="stable")
        key, first = np.unique(key[order], return_index=True)
        total = np.add.reduceat(value[order], first) if len(key) else value
        return np.flatnonzero(new)[key // len(ids)], key % len(ids), total

    def best(rows: pa.Table) -> pa.Table:
        """The best of each query and thread; rows stand in order of their chunks, so of equal ones the first stay."""
        total = rows["total"].to_numpy()
        if len(rows) and abs(total).max() >= 10**15:
            return rows  # beyond what a double holds to the last place: all are ranked after
        score, q = -((total + 5000) // 10_000), rows["q"].to_numpy()
        thread = rows["thread"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        order = np.lexsort((np.arange(len(q)), score, q, thread))
        group = np.concatenate([[True], (q[order][1:] != q[order][:-1]) | (thread[order][1:] != thread[order][:-1])]) if len(q) else np.array([], bool)
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(group, np.arange(len(q)), 0)) if len(q) else np.array([], np.int64)
        kept = np.sort(order[(rank < top_k) & (score[order] < 0)])
        return rows.take(pa.array(kept))

    def run(batches):
        held, waiting, n_waiting = None, [], 0

        def score(table):
            b = table.combine_chunks().to_batches()[0]
            at, q, total = totals(b)
            at = pa.array(at)
            rows = pa.table({"q": pa.array(q.astype(np.int32)), "thread": b.column("thread").take(at), "chunk_id": b.column("chunk_id").take(at), "total": pa.array(total)})
            waiting.append(best(rows))
            return len(waiting[-1])

        for b in batches:
            if not b.num_rows:
                continue
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if len(held) < AT_A_TIME:
                continue
            mark = held["_mark"].to_numpy()
            end = int(np.flatnonzero(mark != mark[-1])[-1]) + 1 if (mark != mark[-1]).any() else 0
            if end:  # the last chunk may go on
                n_waiting += score(held.slice(0, end))
                held = held.slice(end)
            if n_waiting > WAITING:
                waiting[:] = [best(pa.concat_tables(waiting))]
                n_waiting = len(waiting[0])
        if held is not None and len(held):
            score(held)
        if waiting:
            yield from best(pa.concat_tables(waiting)).combine_chunks().to_batches()

    rows = postings.select("thread", "chunk_id", "term", "weight").repartition(parts, "thread", "chunk_id").sortWithinPartitions("thread", "chunk_id")
    rows = rows.withColumn("_mark", F.xxhash64("thread", "chunk_id"))
    found = rows.mapInArrow(run, f"q int, thread {kinds['thread']}, chunk_id {kinds['chunk_id']}, total long")
    known = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("q", IntegerType()), id_field]))
    return found.join(F.broadcast(known), "q").drop("q")


#: Scores that are made at a time (8 MB; a few copies of them are held).
SCORES = 1 << 20


def top_places(own: np.ndarray, asked: np.ndarray, top_k: int, scores: int = SCORES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``asked`` its number, the places of its ``top_k`` nearest rows of ``own``, equal scores in order of place, and
    their scores. Products are made for a few rows of ``asked`` at a time, so that no more than ``scores`` are held."""
    step = max(1, scores // len(own))
    for at in range(0, len(asked), step):
        score = asked[at : at + step] @ own.T
        np.round(score, 6, out=score)
        if len(own) > top_k:  # not a number counts as the least, as a sort from the greatest puts it last
            np.nan_to_num(score, copy=False, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            least = np.partition(score, len(own) - top_k, axis=1)[:, len(own) - top_k]
        for k, row in enumerate(score):
            near = np.flatnonzero(row >= least[k]) if len(own) > top_k else np.arange(len(own))
            near = near[np.argsort(-row[near], kind="stable")[:top_k]]
            yield at + k, near, row[near]


def best_of_block(top_k: int):
    """A function of two pandas frames, vectors (chunk_id, v) and queries (query_id, q): the best ``top_k`` of each query."""

    def best(own, asked):
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        own = own.sort_values("chunk_id")
        ids, ask = own["chunk_id"].to_numpy(), asked["query_id"].to_list()  # may be structs
        stack = lambda c: np.stack(c.to_list()).astype(np.float64)
        found = list(top_places(stack(own["v"]), stack(asked["q"]), top_k))
        asks = pd.Series([ask[i] for i, near, _ in found for _ in near], dtype=object)
        return pd.DataFrame({"query_id": asks, "chunk_id": np.concatenate([ids[near] for _, near, _ in found]), "score": np.concatenate([x for _, _, x in found])})

    return best


def vector_topk(
    vectors: DataFrame, queries: DataFrame, top_k: int = 10, query_rows: int = 2048, vector_rows: int = 65_536, scope: list[str] | None = None
) -> DataFrame:
    """(query_id, chunk_id, rank, score): nearest ``vectors`` (chunk_id, v) to ``queries`` (query_id, q). With ``scope``
    (columns of both, such as user, thread and document) a query meets only the vectors that equal it there; a null
    scope meets nothing.

    Both tables are dealt into blocks of bounded size; each pair of blocks is one product of
    matrices in a task, which keeps the best ``top_k`` of its queries, so few rows are shuffled on."""
    blocks = lambda df, rows: max(1, -(-df.count() // rows))
    nq, nv = blocks(queries, query_rows), blocks(vectors, vector_rows)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.where("v is not null").withColumn("_v", F.pmod(F.xxhash64("chunk_id"), F.lit(nv)).cast("int")).withColumn("_q", each(nq))
    right = queries.where("q is not null").withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")).withColumn("_v", each(nv))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "chunk_id"))]

    keys = [*(scope or []), "_v", "_q"]
    if scope:
        left, right = left.dropna(subset=scope), right.dropna(subset=scope)
    pairs = left.select(*keys, "chunk_id", "v").groupBy(*keys).cogroup(right.select(*keys, "query_id", "q").groupBy(*keys))
    pairs = pairs.applyInPandas(best_of_block(top_k), f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
    return pairs.withColumn("rank", ranked(["query_id"], F.desc("score"), F.asc("chunk_id"))).where(F.col("rank") <= top_k)


def hashed_embeddings(chunks: DataFrame, id_col: str, text_col: str, dim: int = 256, fitted=None) -> tuple[DataFrame, object]:
    """(id, v array<float>) and the fitted model: the default text embedder, hashed term
    frequencies times inverse document frequency, of length one. Pass ``fitted`` to embed queries
    in the space of the chunks. Other embedders take its place where they return (id, v)."""
    words = chunks.select(id_col, tokens(text_col).alias("_words"))
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(words)
    fitted = fitted or IDF(inputCol="_tf", outputCol="_tfidf").fit(counted)
    unit = Normalizer(inputCol="_tfidf", outputCol="_unit").transform(fitted.transform(counted))
    return unit.select(id_col, vector_to_array("_unit", "float32").alias("v")), fitted


def embedding_dim_check(vectors: DataFrame, owner_col: str, vector_col: str, expected: int) -> DataFrame:
    """(owner, dim, n, ok) over all stored vectors."""
    return vectors.groupBy(owner_col, F.size(vector_col).alias("dim")).agg(F.count(F.lit(1)).alias("n")).withColumn("ok", F.col("dim") == expected)


def query_variants(queries: DataFrame, id_col: str, variant_cols: list[str], vector_k: int = 30, bm25_k: int = 20) -> DataFrame:
    """(id, list_id, variant, vector_k, bm25_k): distinct non-empty variants and their share of k."""
    kept = F.array_distinct(F.filter(F.array(*[F.trim(c) for c in variant_cols]), lambda v: v.isNotNull() & (v != "")))
    q = queries.select(id_col, kept.alias("vs")).withColumn("n", F.size("vs"))
    share = lambda k, low: F.when(F.col("n") > 1, F.greatest(F.lit(low), F.expr(f"{k} div n").cast("int"))).otherwise(F.lit(k)).cast("int")
    return q.select(id_col, F.posexplode("vs").alias("list_id", "variant"), share(vector_k, 15).alias("vector_k"), share(bm25_k, 10).alias("bm25_k"))


def rrf_fuse(hits: DataFrame, keys: list[str] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of hits (query_id, list_id, rank from 0, keys): (query_id, keys, score, rank)."""
    keys = keys or ["chunk_id"]
    fused = hits.groupBy("query_id", *keys).agg(exact_sum(1.0 / (F.col("rank") + F.lit(k + 1))).alias("score"), F.min(F.struct("list_id", "rank")).alias("_f"))
    order = (F.desc("score"), F.asc("_f"), *[F.asc(c) for c in keys])
    return fused.withColumn("rank", ranked(["query_id"], *order) - 1).drop("_f")


def boost_hits(hits: DataFrame, matches: Column, keywords: Column, text: Column) -> DataFrame:
    """Hits re-scored by x (1 + 0.25 entity matches + min(0.3, 0.1 keywords in the text))."""
    found = F.size(F.filter(keywords, lambda w: F.contains(F.lower(text), w)))
    score = F.round(F.col("score") * (1 + 0.25 * matches + F.least(F.lit(0.3), 0.1 * found)), 8)
    return hits.withColumn("score", score).withColumn("rank", ranked(["query_id"], F.desc("score"), F.asc("chunk_id")) - 1)


def gate_and_budget(hits: DataFrame, max_total: int = 200, share: float = 0.25) -> DataFrame:
    """Documents whose best hit is under ``share`` of the top one go; each kept one's best hit
    comes first, then the others by score, up to a budget that grows with the documents kept."""
    q, d = Window.partitionBy("query_id"), Window.partitionBy("query_id", "document_id")
    kept = hits.withColumn("_best", F.max("score").over(d)).withColumn("_top", F.max("score").over(q)).where(F.col("_best") >= share * F.col("_top"))
    kept = kept.withColumn("_in", F.row_number().over(d.orderBy(F.desc("score"), "chunk_id")))
    n = F.sum(F.when(F.col("_in") == 1, 1).otherwise(0)).over(q)
    budget = F.when(n <= 2, 40).when(n <= 5, 80).when(n <= 10, 150).otherwise(F.least(F.lit(max_total), 15 * n))
    kept = kept.withColumn("budget", F.least(F.lit(max_total), budget).cast("int"))
    lead = F.when(F.col("_in") == 1, 0).otherwise(1)
    kept = kept.withColumn("rank", F.row_number().over(q.orderBy(lead, F.desc("score"), "chunk_id")) - 1).where("rank < budget")
    return kept.drop("_best", "_top", "_in")


def dedup_content_hash(hits: DataFrame, text_col: str) -> DataFrame:
    """The first hit of each distinct content in a query; hits without a content all stay."""
    first = F.row_number().over(Window.partitionBy("query_id", F.sha2(text_col, 256)).orderBy("rank"))
    return hits.withColumn("_r", F.when(F.col(text_col).isNull(), 1).otherwise(first)).where("_r = 1").drop("_r")


def balanced_topk(hits: DataFrame, k_per_document: int = 6, total_k: int = 12) -> DataFrame:
    """An equal share of each document's hits first, the shortfall from the best others."""
    q, d = Window.partitionBy("query_id"), Window.partitionBy("query_id", "document_id")
    h = hits.withColumn("_in", F.row_number().over(d.orderBy(F.desc("score"), "chunk_id")))
    n = F.sum(F.when(F.col("_in") == 1, 1).otherwise(0)).over(q)
    share = F.when(n == 1, total_k).otherwise(F.least(F.lit(k_per_document), F.ceil(F.lit(total_k) / n)))
    h = h.withColumn("_fill", F.when(F.col("_in") <= share, 0).otherwise(1))
    h = h.withColumn("rank", F.row_number().over(q.orderBy("_fill", F.desc("score"), "chunk_id")) - 1)
    return h.where(F.col("rank") < total_k).drop("_in", "_fill")


def score_pairs(hits: DataFrame, scorer=None) -> DataFrame:
    """``rerank_score``: the sigmoid of a pair scorer (pandas UDF over query and text), or
    1 - i/n by the current order where there is none."""
    if scorer is not None:
        raw = F.least(F.lit(50.0), F.greatest(F.lit(-50.0), scorer("query", "text")))
        return hits.withColumn("rerank_score", 1 / (1 + F.exp(-raw)))
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    i = ranked(["query_id"], F.asc("rank"), F.asc("chunk_id")) - 1
    return hits.withColumn("rerank_score", F.round(1 - i / n, 6))


@F.pandas_udf(DoubleType())
def overlap_scorer(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A pair scorer without a model: the share of a query's words that the text has, as a logit between -4 and
    4. A model would be loaded once, before the first batch of a worker."""
    known: dict[str, frozenset[str]] = {}
    for query, text in pairs:
        scores = []
        for q, t in zip(query, text, strict=True):
            asked = known.setdefault(q or "", frozenset((q or "").split(" ")) - {""})
            scores.append(8 * len(asked.intersection((t or "").split(" "))) / max(1, len(asked)) - 4)
        yield pd.Series(scores, dtype="float64")


def tfidf_cosine(hits: DataFrame, text_col: str) -> DataFrame:
    """(query_id, a, b, sim) for the candidates of a query that share a term."""
    word = hits.select("query_id", "chunk_id", F.explode(F.filter(F.split(F.lower(text_col), r"\s+"), lambda w: w != "")).alias("term"))
    tf = word.groupBy("query_id", "chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    size = tf.groupBy("query_id", "chunk_id").agg(F.sum("tf").alias("len"))
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df")).join(n, "query_id")
    w = tf.join(size, ["query_id", "chunk_id"]).join(df, ["query_id", "term"])
    w = w.select("query_id", "chunk_id", "term", (F.col("tf") / F.col("len") * F.log((F.col("n") + 1) / (F.col("df") + 1))).alias("w")).where("w <> 0")
    norm = w.groupBy("query_id", "chunk_id").agg(F.sqrt(F.sum((F.col("w") * F.col("w")).cast("decimal(28,18)")).cast("double")).alias("norm"))
    a, b = w.toDF("query_id", "a", "term", "wa"), w.toDF("query_id", "b", "term", "wb")
    dot = a.join(b, ["query_id", "term"]).where("a < b").groupBy("query_id", "a", "b").agg(F.sum((F.col("wa") * F.col("wb")).cast("decimal(28,18)")).cast("double").alias("dot"))
    out = dot.join(norm.toDF("query_id", "a", "na"), ["query_id", "a"]).join(norm.toDF("query_id", "b", "nb"), ["query_id", "b"])
    return out.select("query_id", "a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("sim"))


def mmr_select(hits: DataFrame, sims: DataFrame, score_col: str = "rerank_score", top_k: int = 10, diversity: float = 0.5) -> DataFrame:
    """(query_id, chunk_id, mmr_rank): greedy choice by (1 - d) relevance - d largest similarity to
    what is chosen; a query's candidates are bounded by the gate before."""
    kind = hits.schema["chunk_id"].dataType.simpleString()
    qkind = hits.schema["query_id"].dataType.simpleString()

    def choose(key, own, near):
        own = own.sort_values([score_col, "chunk_id"], ascending=[False, True])
        rel = dict(zip(own["chunk_id"], own[score_col], strict=True))
        sim = {}
        for a, b, s in zip(near["a"], near["b"], near["sim"], strict=True):
            sim[a, b] = sim[b, a] = s
        most, chosen = dict.fromkeys(rel, 0.0), []
        while rel and len(chosen) < top_k:
            best = max(rel, key=lambda c: ((1 - diversity) * rel[c] - diversity * most[c], rel[c]))
            chosen.append(best)
            del rel[best]
            for c in rel:
                most[c] = max(most[c], sim.get((best, c), 0.0))
        return pd.DataFrame({"query_id": [key[0]] * len(chosen), "chunk_id": chosen, "mmr_rank": range(len(chosen))})

    return hits.groupBy("query_id").cogroup(sims.groupBy("query_id")).applyInPandas(choose, f"query_id {qkind}, chunk_id {kind}, mmr_rank int")


def expand_parents(hits: DataFrame) -> DataFrame:
    """(query_id, document_id, page_no, n_children, score, text): hits of child chunks joined to the
    distinct parents of their page, in parent order, under the best child's score."""
    parents = hits.groupBy("query_id", "document_id", "page_no", "parent_idx").agg(F.max("score").alias("s"), F.count(F.lit(1)).alias("n"), F.min("parent_text").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("parent_idx", "t"))), lambda x: x["t"]), "\n\n")
    return parents.groupBy("query_id", "document_id", "page_no").agg(F.sum("n").alias("n_children"), F.max("s").alias("score"), text.alias("text"))


def retrieval_confidence(hits: DataFrame, score_col: str = "score") -> DataFrame:
    """(query_id, n, mean, confidence) from the count and the mean score."""
    g = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(exact_sum(F.col(score_col)) / F.count(F.lit(1)), 6).alias("mean"))
    level = F.when((F.col("n") >= 5) & (F.col("mean") >= 0.5), "high").when((F.col("n") >= 3) & (F.col("mean") >= 0.3), "medium")
    return g.withColumn("confidence", level.otherwise("low"))


def content_key(text_col: str) -> Column:
    return F.substring(text_col, 1, 100)


def merge_rounds(first: DataFrame, second: DataFrame, text_col: str) -> DataFrame:
    """``first`` and the rows of ``second`` whose (document, page, start of text) it lacks."""
    key = ["query_id", "document_id", "page_no", "_k"]
    a, b = first.withColumn("_k", content_key(text_col)), second.withColumn("_k", content_key(text_col))
    return a.unionByName(b.join(a.select(*key).distinct(), key, "left_anti")).drop("_k")


def dedup_subqueries(hits: DataFrame, group_col: str, text_col: str) -> DataFrame:
    """The best row of each (group, document, page, start of text) over all sub-queries."""
    w = Window.partitionBy(group_col, "document_id", "page_no", content_key(text_col)).orderBy(F.desc("score"), "query_id", "chunk_id")
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def filter_low_scores(hits: DataFrame, least: float = 0.5, at_least: int = 2, score_col: str = "score") -> DataFrame:
    """Scores from ``least`` on; the best ``at_least`` where fewer pass."""
    q = Window.partitionBy("query_id")
    passing = F.sum(F.when(F.col(score_col) >= least, 1).otherwise(0)).over(q)
    r = F.row_number().over(q.orderBy(F.desc(score_col), "chunk_id"))
    h = hits.withColumn("_p", passing).withColumn("_r", r)
    return h.where(((F.col("_p") >= at_least) & (F.col(score_col) >= least)) | ((F.col("_p") < at_least) & (F.col("_r") <= at_least))).drop("_p", "_r")


def edge_order(hits: DataFrame) -> DataFrame:
    """``position``: best first and last, worst in the middle; two rows or fewer stay as they are."""
    n, r = F.count(F.lit(1)).over(Window.partitionBy("query_id")), F.col("_r")
    h = hits.withColumn("_r", ranked(["query_id"], F.asc("rank"), F.asc("chunk_id")) - 1).withColumn("_n", n)
    moved = F.when(r % 2 == 0, F.expr("_r div 2")).otherwise(F.col("_n") - 1 - F.expr("(_r - 1) div 2"))
    return h.withColumn("position", F.when(F.col("_n") <= 2, r).otherwise(moved).cast("int")).drop("_r", "_n")


def count_tokens(text) -> Column:
    """The default token counter: four characters a token. Any function of a column (a pandas UDF
    over a tokenizer, say) can take its place."""
    return F.ceil(F.length(text) / 4)


def pack_batches(hits: DataFrame, budget: int, reserve: int = 3000, counter=count_tokens) -> DataFrame:
    """(query_id, document_id, tokens, batch): documents by best score, packed in order into batches
    of at most ``budget - reserve`` tokens; a larger document has its own."""
    room = budget - reserve
    doc = hits.groupBy("query_id", "document_id").agg(F.max("score").alias("s"), F.sum(counter(F.col("text"))).alias("tokens"))
    ordered = doc.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), "document_id", "tokens"))).alias("ds"))
    fold = (
        "aggregate(ds, named_struct('b', -1L, 'used', 0L, 'out', cast(array() as array<bigint>)), (s, d) -> CASE WHEN s.b >= 0 AND s.used + d.tokens <= {0}"
        " THEN named_struct('b', s.b, 'used', s.used + d.tokens, 'out', array_append(s.out, s.b))"
        " ELSE named_struct('b', s.b + 1, 'used', d.tokens, 'out', array_append(s.out, s.b + 1)) END, s -> s.out)"
    )
    z = ordered.select("query_id", F.explode(F.arrays_zip("ds", F.expr(fold.format(room)).alias("b"))).alias("z"))
    return z.select("query_id", F.col("z.ds.document_id").alias("document_id"), F.col("z.ds.tokens").alias("tokens"), F.col("z.b").alias("batch"))


def token_budget(queries: DataFrame, text_col: str, window: int = 128_000, reply: int = 8000, margin: int = 2000, counter=count_tokens) -> DataFrame:
    """``budget``: what the context window leaves beside reply, margin and prompt."""
    used = counter(F.coalesce(text_col, F.lit("")))
    return queries.withColumn("budget", F.greatest(F.lit(0), F.lit(window - reply - margin) - used).cast("long"))


def cite(cited: DataFrame, hits: DataFrame) -> DataFrame:
    """The first retrieved row of each cited (query, document, page); unmatched ones go."""
    first = hits.withColumn("_r", ranked(["query_id", "document_id", "page_no"], F.asc("rank"))).where("_r = 1").drop("_r")
    return cited.select("query_id", "document_id", "page_no").distinct().join(first, ["query_id", "document_id", "page_no"])


def confidence_rollup(levels: DataFrame, group_col: str, level_col: str = "confidence") -> DataFrame:
    """(group, confidence): the worst level; low where there is none."""
    worst = F.min(F.when(F.col(level_col) == "high", 2).when(F.col(level_col) == "medium", 1).when(F.col(level_col).isNotNull(), 0))
    return levels.groupBy(group_col).agg(F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.coalesce(worst, F.lit(0)) + 1).alias("confidence"))


def visual_pages(hits: DataFrame, least: float = 0.8, most: int = 5, score_col: str = "score") -> DataFrame:
    """(query_id, pos, document_id, page_no): the first distinct pages with a high score."""
    page = hits.where(F.col(score_col) >= least).groupBy("query_id", "document_id", "page_no").agg(F.min("rank").alias("first"))
    page = page.withColumn("pos", ranked(["query_id"], F.asc("first"), F.asc("document_id"), F.asc("page_no"))).where(F.col("pos") <= most)
    return page.select("query_id", "pos", "document_id", "page_no")


def target_page(hits: DataFrame, flags: DataFrame) -> DataFrame:
    """(query_id, document_id, page_no): the page that a question about a page means, in the document
    of its best hit. ``flags`` (query_id, page, is_last): the explicit page, else the last retrieved
    page of that document, else the best hit's page."""
    best = hits.groupBy("query_id").agg(F.min_by(F.struct("document_id", "page_no"), F.struct("rank", "chunk_id")).alias("m"))
    best = best.select("query_id", "m.document_id", F.col("m.page_no").alias("_own"))
    last = hits.groupBy("query_id", "document_id").agg(F.max("page_no").alias("_last"))
    page = F.coalesce("page", F.when(F.col("is_last"), F.col("_last")), "_own").cast("int").alias("page_no")
    return best.join(last, ["query_id", "document_id"]).join(flags, "query_id").select("query_id", "document_id", page)


#: Words that mark a kind of question.
NLP_WORDS = [
    "sentiment", "theme", "themes", "tone", "opinion", "opinions", "categorize", "categorise", "classify", "classification",
    "analyze comments", "analyse comments", "analyze feedback", "analyse feedback", "positive", "negative", "neutral", "overarching",
    "common patterns", "common themes", "recurring", "feedback analysis", "what do people say", "what are people saying", "mood",
    "attitude", "complaints", "praise", "criticism", "subjective", "qualitative analysis",
]
STYLES = {
    "brief": ["3 bullet points", "summarize", "brief", "short", "concise", "in short", "quick summary"],
    "compare": [
        "compare", "comparison", "contrast", "difference between", "differences between", "how do they differ", "how does it differ",
        "versus", " vs ", " vs.", "side by side", "side-by-side", "which is better", "which one", "similarities and differences",
        "common and different",
    ],
    "analyst": [
        "recommend", "recommendation", "what should", "implications", "strategy", "strategic", "suggest", "advise", "action items",
        "what are the risks", "swot", "pros and cons", "trade-off", "tradeoff", "evaluate", "assessment", "analysis", "analyze", "analyse",
        "what can we learn", "what does this mean", "insights", "common trend", "common themes", "gaps", "opportunities", "trends",
        "trend analysis",
    ],
}
EXCEL_WORDS = [
    "excel", "spreadsheet", "xlsx", "export to file", "download file", "create a file", "pivot table", "create an excel", "make an excel",
    "give me an excel",
]
PAGE = r"(?i)\b(?:page|slide)\s+(\d+)\b|\b(\d+)(?:st|nd|rd|th)?\s*(?:page|slide)\b|\b(last|final)\s+(?:page|slide)\b|\b(first)\s+(?:page|slide)\b"
IMPLICIT = (
    r"(?i)\b(?:flowchart|org\s*chart|organizational\s*chart|below\s+the|above\s+the|in\s+the\s+(?:image|figure|diagram|chart|table)"
    r"|the\s+(?:diagram|flowchart|chart|figure|table)|(?:figure|fig\.?|chart|diagram|table|image|illustration)\s+\d+)\b"
)


def query_flags(df: DataFrame, text_col: str) -> DataFrame:
    """is_nlp, is_excel, style, and what page each question means: its number (the first page is 1),
    the last one, or that of something shown there."""
    text = F.coalesce(text_col, F.lit(""))
    low = F.lower(text)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    style = F.when(any_of(STYLES["brief"]), "brief").when(any_of(STYLES["compare"]), "compare").when(any_of(STYLES["analyst"]), "analyst")
    part = lambda i: F.regexp_extract(text, PAGE, i)
    number = F.coalesce(*[F.nullif(part(i), F.lit("")) for i in (1, 2)]).cast("int")
    page = F.coalesce(number, F.when(part(4) != "", 1))
    implicit = ~text.rlike(PAGE) & text.rlike(IMPLICIT)
    return df.withColumns(
        {"is_nlp": any_of(NLP_WORDS), "is_excel": any_of(EXCEL_WORDS), "style": style.otherwise("detailed"), "page": page, "is_last": part(3) != "", "is_implicit": implicit}
    )
