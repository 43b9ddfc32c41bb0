"""SimHash near-duplicates by vantage-point trees over fingerprints.

Fingerprints within ``max_bits`` agree on at least one of max_bits + 1 pieces. For each piece
one vantage-point tree partitions the distinct fingerprints by Hamming distance: a node holds a
vantage point and a radius, points within the radius go in, others out. On its piece a
fingerprint looks for equal values only (a ball of radius zero), so it goes to one leaf a tree:
``max_bits`` + 1 copies however deep the trees are. A leaf with over ``most_rows`` fingerprints
is dealt again by its piece and then by the bits that vary in it, until no group is larger
(``leaf_groups``), so any number of fingerprints with equal pieces is shared among tasks. Inside a leaf a second tree over the whole fingerprints forms shards, and each fingerprint
queries those that its ball of ``max_bits`` reaches by the triangle bound (in if d - max_bits <=
radius, out if d + max_bits > radius); pairs are compared exactly there. A leaf returns a
spanning forest, not pairs.

The distributed trees' nodes are fitted on a bounded sample (``sample_per_leaf`` times the
leaves, at most 2**20 fingerprints); every fingerprint is indexed and queried, so no link is lost.

``keep_one`` judges texts by the Jaccard similarity of their shingles. Links of the trees are
verified first; similar texts whose fingerprints differ in more bits (about ten of 64 at 0.8)
are found by ``jaccard``.

Edge cases: null or word-less text has fingerprint zero and links like any other; equal
fingerprints share one component; repeated rows are returned as often as they come; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import jaccard
from docmill.llm._common import Scratch, components, cut, let_go, row_keys, small_batches, table

MAX_SAMPLE = 1 << 20


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles: a bit is 1 if set in over half of their XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    k = min(shingle_words, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], seed) for a, b in zip(begins, ends[k - 1 :].tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounds the memory of very long texts
        part = np.array(hashes[i : i + (1 << 16)], ">u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, keys: tuple[str, ...] = ()
) -> DataFrame:
    """(id, fp, *keys): fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        let_go()
        for b in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in b["_text"]], np.uint64)
            yield pd.DataFrame({"_id": b["_id"], "_fp": fps.view(np.int64)} | {k: b[k] for k in keys})

    of = lambda c: docs.schema[c].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *keys)
    made = rows.mapInPandas(run, f"_id {of(id_col)}, _fp long" + "".join(f", `{k}` {of(k)}" for k in keys))
    return made.select(F.col("_id").alias(id_col), F.col("_fp").alias("fp"), *keys)


def piece_bounds(bits: int, pieces: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of each piece."""
    edges = [bits * i // pieces for i in range(pieces + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def piece(u: np.ndarray, low: int, bits: int) -> np.ndarray:
    return (u >> np.uint64(low)) & np.uint64((1 << bits) - 1)


def shares(varying: int, pieces: int) -> list[int]:
    """The set bits of ``varying`` dealt into ``pieces`` masks of neighbouring bits."""
    at = [i for i in range(64) if varying >> i & 1]
    return [sum(1 << i for i in at[a : a + n]) for a, n in piece_bounds(len(at), pieces)]


def build_tree(points: np.ndarray, depth: int, bits: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a full binary tree; node i has children 2i+1 (in), 2i+2 (out)."""
    rng = np.random.default_rng(seed)
    vantage, radius = np.zeros(2**depth - 1, np.uint64), np.full(2**depth - 1, bits // 2, np.int16)
    held = {0: points}
    for node in range(2**depth - 1):
        own = held.pop(node, points[:0])
        if len(own):
            vantage[node] = own[rng.integers(len(own))]
            d = np.bitwise_count(own ^ vantage[node])
            radius[node] = np.median(d)
            if radius[node] == d.max() and d.min() < d.max():  # ties: the outermost shell goes out
                radius[node] -= 1
            held[2 * node + 1], held[2 * node + 2] = own[d <= radius[node]], own[d > radius[node]]
    return vantage, radius


def route(points: np.ndarray, vantage: np.ndarray, radius: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of each point."""
    node = np.zeros(len(points), np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (np.bitwise_count(points ^ vantage[node]) > radius[node])
    return node - (2**depth - 1)


def forest(n: int, i: np.ndarray, j: np.ndarray, lab: np.ndarray | None = None) -> np.ndarray:
    """Smallest-index root of each of n points after the links i-j are added."""
    lab = np.arange(n) if lab is None else lab
    while True:
        a, b = lab[i], lab[j]
        apart = a != b
        if not apart.any():
            return lab
        np.minimum.at(lab, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (lab[lab] != lab).any():
            lab = lab[lab]


def shards(u: np.ndarray, max_bits: int, shard_rows: int):
    """(members, queries) of a vantage-point tree's shards: each query's ball reaches the shard."""
    rng = np.random.default_rng(len(u))
    todo = [(np.arange(len(u)), np.arange(len(u)))]
    while todo:
        own, asks = todo.pop()
        if len(own) > shard_rows:
            v = u[own[rng.integers(len(own))]]
            d, e = (np.bitwise_count(u[x] ^ v).astype(np.int16) for x in (own, asks))
            radius = int(np.median(d))
            radius -= radius == d.max()
            inside = d <= radius
            if inside.any() and not inside.all():
                todo += [(own[inside], asks[e - max_bits <= radius]), (own[~inside], asks[e + max_bits > radius])]
                continue
        yield own, asks


def compare_leaf(fps: np.ndarray, max_bits: int, shard_rows: int = 256, block: int = 128):
    """Spanning forest (fp, root fp) of all links within a leaf."""
    u = fps.view(np.uint64)
    lab = np.arange(len(u))
    for own, asks in shards(u, max_bits, shard_rows):
        for k in range(0, len(asks), block):
            h = asks[k : k + block]
            i, j = np.nonzero(np.bitwise_count(u[h][:, None] ^ u[own][None, :]) <= max_bits)
            apart = h[i] != own[j]
            if apart.any():
                lab = forest(len(u), h[i[apart]], own[j[apart]], lab)
    tied = np.flatnonzero(lab != np.arange(len(u)))
    return fps[tied], fps[lab[tied]]


def leaf_groups(distinct: DataFrame, max_bits: int, leaf_rows: int, most_rows: int, sample_per_leaf: int, cut=cut) -> DataFrame:
    """(leaf, sub, fp): groups of which at least one holds both ends of any link. A leaf of over
    ``most_rows`` is dealt by its tree's piece, as links agree in one; a group still larger by the
    bits that vary in it, in ``max_bits`` + 1 shares, in one of which a link agrees, and so on. Each
    step leaves fewer varying bits, and n of them tell only 2**n fingerprints apart, so no group
    stays larger."""
    n = distinct.count()
    parts = piece_bounds(64, max_bits + 1)
    most_depth = int(np.log2(MAX_SAMPLE / sample_per_leaf))
    depth = max(0, min(int(np.ceil(np.log2(max(n, 1) / leaf_rows))), most_depth, min(b for _, b in parts)))
    step = max(1, n // min(MAX_SAMPLE, sample_per_leaf * 2**depth))
    some = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(step)) == 0).select("fp").orderBy("fp").limit(MAX_SAMPLE)
    sample = some.toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    trees = [build_tree(piece(sample, low, bits), depth, bits) for low, bits in parts]

    def visits(batches):
        for b in batches:
            fps = b["fp"].to_numpy(np.int64)
            for t, ((low, bits), (vantage, radius)) in enumerate(zip(parts, trees, strict=True)):
                leaf = route(piece(fps.view(np.uint64), low, bits), vantage, radius, depth)
                yield pd.DataFrame({"leaf": t * 2**depth + leaf, "sub": np.int64(-1), "fp": fps})

    def split(batches):
        for b in batches:
            for (t, whole, varying), own in b.groupby([b["leaf"] // 2**depth, b["sub"] == -1, b["varying"]]):
                low, bits = parts[t]
                masks = [((1 << bits) - 1) << low] if whole else shares(int(varying) & 2**64 - 1, max_bits + 1)
                fps = own["fp"].to_numpy(np.int64)
                for q, mask in enumerate(masks):
                    value = (fps.view(np.uint64) & np.uint64(mask)).view(np.int64)
                    yield pd.DataFrame({"leaf": own["leaf"], "sub": own["sub"], "q": q, "value": value, "fp": fps})

    todo = distinct.select("fp").mapInPandas(visits, "leaf long, sub long, fp long")
    done = None
    while True:
        varying = F.bit_or("fp").bitwiseAND(F.bitwise_not(F.bit_and("fp"))).alias("varying")
        size = todo.groupBy("leaf", "sub").agg(F.count(F.lit(1)).alias("n"), varying)
        big = cut(size.where(F.col("n") > max(most_rows, 2**max_bits)).drop("n"), "big_leaves")
        if big.isEmpty():
            return todo if done is None else done.unionByName(todo)
        rest = todo.join(big, ["leaf", "sub"], "left_anti")
        done = rest if done is None else done.unionByName(rest)
        again = todo.join(big, ["leaf", "sub"]).mapInPandas(split, "leaf long, sub long, q int, value long, fp long")
        todo = cut(again.select("leaf", F.xxhash64("sub", "q", "value").alias("sub"), "fp"), "split_leaves")


def tree_links(distinct: DataFrame, max_bits: int = 3, leaf_rows: int = 1024, most_rows: int = 8192, sample_per_leaf: int = 16, cut=cut) -> DataFrame:
    """(a, b): links of ``distinct`` (fp long, no two equal) that connect all fingerprints at most ``max_bits`` apart."""

    def compare(pdf):
        a, b = compare_leaf(pdf["fp"].to_numpy(np.int64), max_bits)
        return pd.DataFrame({"a": a, "b": b})

    sent = leaf_groups(distinct, max_bits, leaf_rows, most_rows, sample_per_leaf, cut)
    return cut(sent.groupBy("leaf", "sub").applyInPandas(compare, "a long, b long"), "links")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    max_bits: int = 3,
    leaf_rows: int = 1024,
    most_rows: int = 8192,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """(id, fp, fingerprint, label, component_id, *keys): classes of documents linked by
    fingerprints at most ``max_bits`` apart. Equal labels: one class; component_id is the
    smallest id in it (classes may share one where ids repeat)."""
    each = cut(fingerprints(docs, id_col, text_col, shingle_words, keys), "fingerprints")
    scratch = Scratch(docs.sparkSession)
    distinct = scratch.cut(each.groupBy("fp").agg(F.min(id_col).alias("_first")), "distinct")
    labels = components(tree_links(distinct, max_bits, leaf_rows, most_rows, cut=scratch.cut), "a", "b", scratch.cut)
    classes = distinct.join(labels, distinct.fp == labels.node, "left").select(
        "fp", "_first", F.coalesce("label", "fp").alias("label")
    )
    classes = scratch.cut(classes, "classes")
    least = classes.groupBy("label").agg(F.min("_first").alias("component_id"))
    by_fp = cut(classes.join(least, "label").select("fp", "label", "component_id"), "by_fp")
    scratch.clear()
    text = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return each.join(by_fp, "fp").select(id_col, "fp", text, "label", "component_id", *keys)


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, threshold: float = 0.8, max_bits: int = 3
) -> DataFrame:
    """The rows of ``docs`` with one row of each class of texts that links of a Jaccard
    similarity of ``threshold`` or more connect: the one with the smallest id. Rows without a
    text are kept; a row without an id gives way to one with an id."""
    rows, keys = row_keys(docs)
    texts = rows.where(F.col(text_col).isNotNull())
    trees = near_duplicates(texts, id_col, text_col, shingle_words, max_bits, keys=keys).select(*keys, F.col("label").alias("tree"))
    found = jaccard.near_duplicates(rows, id_col, text_col, shingle_words, threshold, keys=keys, seeds=trees)
    first = found.groupBy("label").agg(F.min(F.struct(F.col(id_col).isNull(), id_col, *keys)).alias("m"))
    first = cut(first.select(*[F.col("m")[k].alias(k) for k in keys]), "first")
    kept = texts.dropDuplicates(list(keys)).join(first, list(keys), "left_semi")
    return kept.unionByName(rows.where(F.col(text_col).isNull())).select(*docs.columns)


def op3_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")
