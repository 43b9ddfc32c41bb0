"""Near-duplicates by exact Jaccard similarity of word shingles.

Texts are linked if their sets of ``shingle_words``-word shingles have a Jaccard similarity of
``threshold`` or more. Under any one order of all shingles such sets share one of the first
n - ceil(threshold n) + 1 of their n shingles, so texts that share such a shingle are the
candidates and no link is lost. The order puts shingles that are common in a bounded sample
last, and before them those that lead over ``BUSY`` texts of the whole table, which a passage's do
whose share of the texts is too small for the sample: else a passage's candidates would grow with
the square of its texts. They are counted once, and again for each factor of ``FEWER`` that the
table has over the sample, as shingles that take their place may be of the same passage. The
order decides how many candidates there are, not which links are found. In two rounds each shingle's texts are compared with one of them and linked texts are contracted; then
all pairs of texts that are not yet connected are compared. Pairs of long texts go by their
sketches first (128 bins of the shingles' hashes, eight bits of the least in each): under half
of the bins agree for a pair at 0.8 with a chance of about 1e-12. Whole sets decide on the rest.

This completes ``simhash.keep_one``: links that its trees found (``seeds``) are verified first,
and their texts are then one text to the rounds. At 0.8 fingerprints differ in about ten of 64
bits, and a ball of that radius reaches nearly every leaf of a tree over them.

Edge cases: null texts are left out, so they are never copies; texts without words are copies
of each other; texts with equal words are one text; texts of fewer words are one shingle.
Words and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm._common import Scratch, WordHashes, components, held, lean, small_batches
from docmill.llm._common import cut as save

SAMPLE, MAX_COMMON = 4000, 1 << 18
BUSY, FEWER = 16, 64
KNOWN_BYTES = 32 << 20


MIX = np.uint64(0x9FB21C651E98DF25)
BINS, SKETCHED = 128, 128


def word_line(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def line_key(line: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(line)).view(np.int64))


def shingles(words: np.ndarray, shingle_words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text's word hashes."""
    if not len(words):
        return np.zeros(0, np.int64)
    k = min(shingle_words, len(words))
    n = len(words) - k + 1
    made = np.full(n, k, np.uint64)
    for j in range(k):
        made = (made ^ (made >> np.uint64(29))) * MIX + words[j : j + n]
    made = (made ^ (made >> np.uint64(32))) * MIX
    return np.unique((made ^ (made >> np.uint64(29))).view(np.int64))


def sketch(own: np.ndarray) -> bytes:
    """By range of hashes, eight bits of the first one; 0 where there is none. No bytes for few shingles."""
    if len(own) < SKETCHED:
        return b""
    edges = (np.arange(BINS + 1, dtype=np.float64) / BINS - 0.5) * 2.0**64
    at = np.searchsorted(own, edges[:-1].astype(np.int64))
    filled = at < np.append(at[1:], len(own))
    first = own[np.minimum(at, len(own) - 1)]
    return np.where(filled, (first & 0xFF) % 255 + 1, 0).astype(np.uint8).tobytes()


def may_be_alike(a: bytes, b: bytes) -> bool:
    if not a or not b:
        return True
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    return 2 * int(((x == y) & (x > 0)).sum()) >= int(((x > 0) | (y > 0)).sum())


def leading(own: np.ndarray, common: np.ndarray, place: np.ndarray, threshold: float) -> np.ndarray:
    """The shingles that a similar set shares one of: rare ones first, then by ``place``."""
    many = len(own) - math.ceil(threshold * len(own) - 1e-9) + 1
    if not len(own) or not len(common):
        return own[:many]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    return own[np.argsort(np.where(common[at] == own, place[at], -1), kind="stable")][:many]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    threshold: float = 0.8,
    keys: tuple[str, ...] = (),
    seeds: DataFrame | None = None,
) -> DataFrame:
    """(id, key, label, component_id, *keys) of each row with a text. Equal labels: one class;
    component_id is the smallest id in it. ``seeds`` (the columns ``keys``, tree) names rows that
    may be alike."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    cut = scratch.cut
    of = lambda c: docs.schema[c].dataType.simpleString()
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *keys)

    def keyed(batches):
        for b in batches:
            made = np.array([line_key(word_line(t)) for t in b["_text"]], np.int64)
            yield pd.DataFrame({"_id": b["_id"], "key": made} | {k: b[k] for k in keys})

    each = cut(rows.mapInPandas(lean(keyed), f"_id {of(id_col)}, key long" + "".join(f", `{k}` {of(k)}" for k in keys)), "keys")
    step = max(1, each.count() // SAMPLE)

    def sampled(batches):
        hashes = held("words", WordHashes)
        for b in batches:
            for text in b["_text"]:
                if (key := line_key(word_line(text))) % step == 0:
                    yield pd.DataFrame({"hash": shingles(hashes(text), shingle_words)}).assign(key=key)

    seen = rows.select("_text").mapInPandas(lean(sampled), "hash long, key long").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    top = seen.where("n > 2").orderBy(F.desc("n"), "hash").limit(MAX_COMMON).toPandas()
    late = top["hash"].to_numpy(np.int64)  # from the last of the order to the first after all others

    def leads(late, count_only=False):
        by = np.argsort(late)
        common, place = late[by], (len(late) - by).astype(np.int64)

        def run(batches):
            hashes = held("words", WordHashes)
            for b in batches:
                sets = [shingles(hashes(t), shingle_words) for t in b["_text"]]
                first = [leading(own, common, place, threshold) for own in sets]
                if sets and count_only:
                    yield pd.DataFrame({"hash": np.concatenate(first)})
                elif sets:
                    keys_, sizes, times = [line_key(word_line(t)) for t in b["_text"]], list(map(len, sets)), list(map(len, first))
                    each = {"hash": np.concatenate(first), "key": np.repeat(keys_, times), "size": np.repeat(sizes, times), "sketch": None}
                    yield pd.DataFrame(each)
                    yield pd.DataFrame({"hash": None, "key": keys_, "size": sizes, "sketch": list(map(sketch, sets))})

        return rows.select("_text").mapInPandas(lean(run), "hash long" if count_only else "hash long, key long, size int, sketch binary")

    for _ in range(math.ceil(math.log(step, FEWER))):
        busy = leads(late, count_only=True).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUSY)
        busy = busy.orderBy(F.desc("n"), "hash").limit(MAX_COMMON + len(late)).toPandas()["hash"].to_numpy(np.int64)
        late = np.concatenate([late, busy[~np.isin(busy, late)][:MAX_COMMON]])
    made = cut(leads(late), "leads")
    entries = made.where("hash is not null").select("hash", "key", "size")
    shared = cut(entries.groupBy("hash").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("hash"), "common")
    entries = cut(entries.join(shared, "hash", "left_semi").distinct(), "shared")
    sketches = made.where("sketch is not null").select("key", "sketch").join(entries.select("key").distinct(), "key", "left_semi")
    sketches = cut(sketches.dropDuplicates(["key"]), "sketches")

    def alike(batches):
        for b in batches:
            yield b.loc[[may_be_alike(x, y) for x, y in zip(b["x"], b["y"], strict=True)], ["a", "b"]]

    def whole(batches):
        for b in batches:
            lines = [word_line(t) for t in b["_text"]]
            yield pd.DataFrame({"key": [line_key(x) for x in lines], "line": lines})

    def verify(batches):
        hashes, known, size = held("words", WordHashes), {}, 0
        for b in batches:
            if size > KNOWN_BYTES:
                known, size = {}, 0
            for line in (*b["x"], *b["y"]):
                if line not in known:
                    known[line] = shingles(hashes(line.decode("utf-8", "surrogatepass")), shingle_words)
                    size += len(line) + known[line].nbytes
            yield b.loc[[similarity(known[x], known[y]) >= threshold - 1e-9 for x, y in zip(b["x"], b["y"], strict=True)], ["a", "b"]]

    def both(pairs, values):
        """``pairs`` with the value of each side as x and y."""
        named = lambda key, value: values.toDF(key, value)
        return pairs.join(named("a", "x"), "a").join(named("b", "y"), "b").select("a", "b", "x", "y")

    def verified(pairs):
        """The pairs that are similar; texts travel only for pairs whose sketches may be."""
        likely = cut(both(cut(pairs.distinct(), "pairs"), sketches).mapInPandas(alike, "a long, b long"), "likely")
        needed = cut(likely.select(F.col("a").alias("key")).union(likely.select("b")).distinct(), "needed")
        lines = rows.select("_text").mapInPandas(lean(whole), "key long, line binary").join(needed, "key", "left_semi").dropDuplicates(["key"])
        return cut(both(likely, cut(lines, "lines")).mapInPandas(lean(verify), "a long, b long"), "links")

    near = (F.least("n", "size") >= threshold * F.greatest("n", "size") - 1e-9) & (F.col("label") != F.col("other"))
    links, open_ = None, entries.withColumn("label", F.col("key"))
    relabelled = lambda labels: entries.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    if seeds is not None:
        known = cut(each.join(seeds, list(keys)).select("tree", "key").distinct(), "seeds")
        heads = known.groupBy("tree").agg(F.min("key").alias("a"), F.max("key").alias("_high")).where("a < _high").select("tree", "a")
        links = verified(known.join(heads, "tree").where("a <> key").select("a", F.col("key").alias("b")))
        open_ = cut(relabelled(components(links, "a", "b", cut)), "open")
    for last in (False, False, True):
        mixed = open_.groupBy("hash").agg(
            F.min("label").alias("_low"), F.max("label").alias("_high"), F.max(F.struct("label", F.col("key").alias("a"), F.col("size").alias("n"))).alias("m")
        ).where("_low < _high")
        if last:
            rest = cut(open_.join(mixed.select("hash"), "hash", "left_semi"), "rest")
            mates = rest.select("hash", F.col("key").alias("a"), F.col("size").alias("n"), F.col("label").alias("other"))
            pairs = rest.join(mates, "hash").where(near & (F.col("a") < F.col("key")))
        else:
            heads = mixed.select("hash", "m.a", "m.n", F.col("m.label").alias("other"))
            pairs = open_.join(heads, "hash").where(near)
        made = verified(pairs.select("a", F.col("key").alias("b")))
        links = made if links is None else links.union(made)
        labels = cut(components(links, "a", "b", cut), "labels")
        if not last:
            open_ = cut(relabelled(labels), "open")
    named = each.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = save(named, "named")
    scratch.clear()
    least = named.groupBy("label").agg(F.min("_id").alias("component_id"))
    return named.join(least, "label").select(F.col("_id").alias(id_col), "key", "label", "component_id", *keys)
