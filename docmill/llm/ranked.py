"""Ranked lexical search by bit-sliced Bloom signatures.

``build_index`` packs the texts of each task, ordered by size, into blocks: one bit matrix a block, a
column a text, rows by hashes of its terms (and of its terms held at least 2, 3, 5, 9, ... times). The
rows of a term ANDed are a bitmap of the texts that may hold it: it overestimates, never under.
``search`` sums the query terms' weights over these bitmaps to upper bounds of every text's score,
rescores the texts of the greatest bounds exactly to learn each query's least score that can still
count, and then rescores exactly every text that its bound doesn't exclude. Nothing is
approximate in the result.

Queries are taken in blocks of at most ``MOST_TERMS`` words, each against all rows. Null and empty
texts hold no term and are never found; queries without terms find nothing; equal scores stand by
ascending id, rows without an id last; equal rows each have a rank. A query row is a query of
its own, even if another has its id.
"""

from __future__ import annotations

import math
from collections import Counter
from heapq import nlargest

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm._common import Scratch, cut, table

#: Every byte below 128 that is no digit and no letter lies between words; A-Z become a-z.
SEPARATED = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
#: A text is entered once for each of these numbers of times that it holds a term.
TIMES = (1, *(2**k + 1 for k in range(20)))
#: Bits of the matrix for each entry of a block's largest text, and the rows that an entry sets: about
#: one term in 400 that a text doesn't hold seems to be there.
BITS = 16
BLOCK = 512
PENDING = 4_000_000
MOST_TERMS = 2**17
MOST_KEYS = 500_000
KEY = ["k1", "k2"]


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(SEPARATED).split()


class Hashes:
    """64-bit hashes of terms; remembers them."""

    CACHED = 300_000

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words) -> np.ndarray:
        if len(self.known) > self.CACHED:
            self.known = {}
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, 7)
        return np.fromiter((known[w] for w in words), np.uint64, len(words))


def rows_of(hashes: np.ndarray, level: int, n_rows: int) -> tuple[np.ndarray, ...]:
    """The four rows of each term at a level of times."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 2**64 - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    a, b, n = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1), np.uint64(n_rows)
    return tuple((a + np.uint64(k) * b) % n for k in range(4))


def packed(texts: list[tuple]) -> dict:
    """The signature block of texts (k1, k2, n, hashes, times)."""
    wide = -(-len(texts) // 8)
    n_rows = max(64, BITS * max(sum(int((t >= x).sum()) for x in TIMES) for *_, t in texts))
    bits = np.zeros((n_rows, wide), np.uint8)
    for d, (*_, hashes, times) in enumerate(texts):
        for level, least in enumerate(TIMES):
            held = hashes[times >= least]
            if not len(held):
                break
            for r in rows_of(held, level, n_rows):
                bits[r, d >> 3] |= np.uint8(128 >> (d & 7))
    k1, k2, n, _, times = zip(*texts, strict=True)
    top = [int(t.max()) for t in times]
    return {"n_rows": n_rows, "bits": bits.tobytes(), "k1": k1, "k2": k2, "n": n, "top": top, "total": sum(n)}


def blocks(batches):
    """Signature blocks of the texts (k1, k2, text) of a task; texts without terms have none."""
    hashed, held, size = Hashes(), [], 0

    def flush():
        held.sort(key=lambda x: len(x[3]))
        at = 0
        while at < len(held):
            most, end = max(32, 2 * len(held[at][3])), at
            while end < len(held) and end - at < BLOCK and len(held[end][3]) <= most:
                end += 1
            yield packed(held[at:end])
            at = end
        held.clear()

    for b in batches:
        for k1, k2, text in zip(b["k1"], b["k2"], b["text"], strict=True):
            if own := Counter(terms(text)):
                held.append((k1, k2, sum(own.values()), hashed(own), np.fromiter(own.values(), np.int64, len(own))))
                size += len(own)
                if size > PENDING:
                    yield pd.DataFrame(flush())
                    size = 0
        if len(held) >= 16 * BLOCK:
            yield pd.DataFrame(flush())
            size = 0
    if held:
        yield pd.DataFrame(flush())


def build_index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Blocks (n_rows, bits, k1, k2, n, top, total) over whole texts; to be written by the caller."""
    kind = "n_rows int, bits binary, k1 array<long>, k2 array<long>, n array<long>, top array<long>, total long"
    return keyed(docs, text_col).mapInPandas(blocks, kind)


def keyed(docs: DataFrame, text_col: str, *more: str) -> DataFrame:
    """Texts with two hashes of their own: copies share them, and rows need no ids."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(*more, F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))


class Queries:
    """A block of queries in the form that tasks need: their terms, weights, and who asks how often."""

    def __init__(self, asked: list[tuple[int, str]], n_docs: int, total: int):
        self.n_docs, self.total = n_docs, total
        own = {q: Counter(terms(text)) for q, text in asked}
        self.queries = [q for q in own if own[q]]
        self.terms = sorted({t for q in self.queries for t in own[q]})
        at = {t: i for i, t in enumerate(self.terms)}
        self.own = [{t: c for t, c in own[q].items()} for q in self.queries]
        self.flat = np.array([at[t] for o in self.own for t in o], np.int64)
        self.counts = np.array([c for o in self.own for c in o.values()], np.int64)
        self.starts = np.cumsum([0] + [len(o) for o in self.own])[:-1]
        self.weights: np.ndarray = np.zeros(len(self.terms), np.int64)

    def weigh(self, holders: dict[bytes, int]) -> None:
        """Weights by the numbers of texts that hold each term."""
        self.weights = np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * holders.get(t, 0) + 1))) for t in self.terms], np.int64)

    def norm(self, n):
        return 75 + 25 * n * self.n_docs // self.total

    def bounds(self, block: dict, hashes: np.ndarray) -> np.ndarray:
        """Upper bounds (query, text) of the scores in a signature block."""
        n_docs = len(block["n"])
        bits = np.frombuffer(block["bits"], np.uint8).reshape(block["n_rows"], -1)
        norm, top = self.norm(np.asarray(block["n"], np.int64)), np.asarray(block["top"], np.int64)
        part = np.zeros((len(self.terms), n_docs), np.int64)
        may, who = None, np.arange(len(self.terms))
        for level in range(len(TIMES)):
            a, b, c, d = rows_of(hashes[who], level, block["n_rows"])
            got = bits[a] & bits[b] & bits[c] & bits[d]
            may = got if may is None else may & got  # who holds a term five times also holds it three times
            some = may.any(axis=1)
            may, who = may[some], who[some]
            if not len(who):
                break
            times = np.minimum(TIMES[level + 1] - 1 if level + 1 < len(TIMES) else top, top)
            t, d = np.nonzero(np.unpackbits(may, axis=1, count=n_docs))
            part[who[t], d] = self.weights[who[t]] * (10**9 * times // (1000 * times + 12 * norm))[d]
        return np.add.reduceat(part[self.flat] * self.counts[:, None], self.starts, axis=0)

    def score(self, q: int, held: Counter, n: int) -> int:
        m, out = self.norm(n), 0
        for t, c in self.own[q].items():
            if tf := held.get(t):
                out += c * self.weight[t] * (10**9 * tf // (1000 * tf + 12 * m))
        return out

    @property
    def weight(self) -> dict[bytes, int]:
        if "_weight" not in self.__dict__:
            self._weight = dict(zip(self.terms, self.weights.tolist(), strict=True))
        return self._weight


def holders(docs: DataFrame, asked: Queries) -> dict[bytes, int]:
    """The numbers of rows that hold each of the queries' terms."""
    wanted = frozenset(asked.terms)

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                seen.update(wanted.intersection(terms(text)))
        if seen:
            yield pd.DataFrame({"term": list(seen), "n": list(seen.values())})

    each = docs.select("text").mapInPandas(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in each.collect()}  # at most one row a term of the block


def greatest_bounds(index: DataFrame, asked: Queries, k: int) -> DataFrame:
    """(q, k1, k2, bound): each task's ``k`` texts with the greatest bounds of each query."""

    def run(batches):
        hashes = Hashes()(asked.terms)
        best: list[list] = [[] for _ in asked.queries]
        for b in batches:
            for block in b.to_dict("records"):
                bound = asked.bounds(block, hashes)
                few = np.argsort(-bound, axis=1, kind="stable")[:, :k]
                for q, ds in enumerate(few):
                    own = [(int(bound[q, d]), int(block["k1"][d]), int(block["k2"][d])) for d in ds if bound[q, d] > 0]
                    best[q] = nlargest(k, best[q] + own)
        out = [(asked.queries[q], k1, k2, v) for q, own in enumerate(best) for v, k1, k2 in own]
        if out:
            yield pd.DataFrame(out, columns=["q", "k1", "k2", "bound"])

    return index.select("n_rows", "bits", "k1", "k2", "n", "top").mapInPandas(run, "q long, k1 long, k2 long, bound long")


def not_excluded(index: DataFrame, asked: Queries, least: dict[int, int]) -> DataFrame:
    """(k1, k2, qs): the texts that may reach the ``least`` score of the queries ``qs``."""
    low = np.array([max(1, least.get(q, 1)) for q in asked.queries], np.int64)

    def run(batches):
        hashes, names = Hashes()(asked.terms), np.array(asked.queries)
        for b in batches:
            out = []
            for block in b.to_dict("records"):
                may = asked.bounds(block, hashes) >= low[:, None]
                for d in np.nonzero(may.any(axis=0))[0]:
                    out.append((block["k1"][d], block["k2"][d], names[may[:, d]]))
            if out:
                yield pd.DataFrame(out, columns=["k1", "k2", "qs"]).drop_duplicates(KEY)

    found = index.select("n_rows", "bits", "k1", "k2", "n", "top").mapInPandas(run, "k1 long, k2 long, qs array<long>")
    return found.groupBy(*KEY).agg(F.first("qs").alias("qs"))  # equal texts have equal bounds


def rescored(docs: DataFrame, found: DataFrame, asked: Queries, k: int, id_type: str) -> DataFrame:
    """(q, id, score): each task's ``k`` best rows of each query among the texts ``found``."""
    at = {q: i for i, q in enumerate(asked.queries)}

    def order(x):
        return (x[0], x[1] is not None, -x[1] if x[1] is not None else 0)

    def run(batches):
        best: dict[int, list] = {}
        for b in batches:
            for i, text, qs in zip(b["id"], b["text"], b["qs"], strict=True):
                held = Counter(terms(text))
                n = sum(held.values())
                for q in qs:
                    if s := asked.score(at[q], held, n):
                        own = best.setdefault(q, [])
                        own.append((s, None if i is None or i != i else int(i)))
                        if len(own) > 8 * k:
                            best[q] = nlargest(k, own, key=order)
        out = [(q, i, s) for q, own in best.items() for s, i in nlargest(k, own, key=order)]
        if out:
            yield pd.DataFrame({"q": [x[0] for x in out], "id": pd.array([x[1] for x in out], "Int64"), "score": [x[2] for x in out]})

    few = F.broadcast(found) if found.count() <= MOST_KEYS else found
    return docs.join(few, KEY).select("id", "text", "qs").mapInPandas(run, f"q long, id {id_type}, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str, item_col: str, text_col: str = "text", k: int = 20) -> DataFrame:
    """(q, rank, id, score): the ``k`` rows of ``docs`` with the highest scores above 0 for each row
    of ``items``, where q numbers the rows of the written table that comes second."""
    scratch = Scratch(docs.sparkSession)
    index = scratch.cut(build_index(docs, text_col), "signatures")
    found = index.agg(F.sum(F.size("n")).alias("n"), F.sum("total").alias("t")).first()
    rows = keyed(docs, text_col, F.col(f"`{id_col}`").alias("id"))
    kind = rows.schema["id"].dataType.simpleString()
    numbered = cut(items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").alias("asks")).withColumn("q", F.monotonically_increasing_id()), "queries")
    sizes = numbered.agg(F.sum(F.octet_length("asks") / 2 + 1)).first()[0] or 0
    n_blocks = max(1, math.ceil(sizes / MOST_TERMS))
    top = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    out = None
    for b in range(n_blocks if found["n"] else 0):
        own = numbered.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == b)
        asked = Queries([(r["q"], r["asks"]) for r in own.select("q", "asks").collect()], found["n"], found["t"])
        if not asked.queries:
            continue
        asked.weigh(holders(rows, asked))
        first = greatest_bounds(index, asked, k).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), *KEY))).where(F.col("r") <= k)
        first = scratch.cut(first.groupBy(*KEY).agg(F.collect_set("q").alias("qs")), "first")
        tried = rescored(rows, first, asked, k, kind).withColumn("r", F.row_number().over(top)).where(F.col("r") == k)
        least = {r["q"]: r["score"] for r in tried.collect()}  # one row a query
        may = scratch.cut(not_excluded(index, asked, least), "candidates")
        best = rescored(rows, may, asked, k, kind).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        best = cut(best.join(numbered.select("q", "item"), "q").select("item", "q", "rank", "id", "score"), "ranks")
        out = best if out is None else out.unionByName(best)
    scratch.clear()
    return out if out is not None else docs.sparkSession.createDataFrame([], f"item {numbered.schema['item'].dataType.simpleString()}, q long, rank int, id {kind}, score long")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return out.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
