"""Merkle dataset manifest with octopus multiproofs.

Every row is a leaf, a digest of its fields. The leaves of a group (a language, say) stand in an
exact order; runs of two become their parent, up to the group's subroot, and the subroots in the
order of the groups likewise become the root. Groups of any size are ranked by range partitions
and built block by block (2**``levels`` nodes each), so no task holds a group.

``prove`` deals the asked leaves into partitions of one block each. A partition computes the
minimal union of the nodes that its proofs lack (octopus: siblings of known nodes that are
not known themselves, level by level), all partitions fetch theirs in one join, and each then
derives the interiors that its leaves share and writes out every single proof.

Null fields have a digest of their own ('-'), nulls come first in any order, and rows of equal order
stand by their digests; equal rows are interchangeable and each has its own proof. An empty
table has no root and no proofs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm._common import Scratch, cut, table

LEVELS = 12
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class Manifest(NamedTuple):
    """leaves (tree, rank, n, leaf and carried columns), nodes (tree, level, idx, hash), trees (tree, n,
    name, subroot), their number and the root (None for an empty table)."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    n_trees: int
    root: str | None


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*cols: Column) -> Column:
    """The digest of a row: its fields, each with its length in bytes, one after another."""
    return F.sha2(F.concat(*map(field, cols)), 256)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    return (n - 1).bit_length()


def width(n: int, level: int) -> int:
    """The nodes of a level over ``n`` leaves."""
    return -(-n >> level)


def in_order(df: DataFrame, groups: list[str], order: list[str], name: str, scratch) -> DataFrame:
    """``df`` written with its 0-based ``name`` in each group by ``order``. Range partitions split a
    group wherever it is long; the partitions' counts give each one's start. Columns hold no nulls."""
    parts = scratch.cut(df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", *groups, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    rank = F.col("_start") + F.row_number().over(Window.partitionBy("_part", *groups).orderBy(*order)) - 1
    return scratch.cut(parts.join(starts, ["_part", *groups]).withColumn(name, rank).drop("_part", "_start"), "ranked")


def raised(base: int, levels: int):
    """A function of one block of nodes of level ``base``: the nodes of the levels above it, up to
    ``levels`` of them or to the tree's top, and the block itself at level 0."""

    def run(key, block):
        tree, first = int(key[0]), int(key[1]) << levels
        n = int(block["n"].iloc[0])
        row = block.sort_values("idx")["hash"].tolist()
        out = [(base, first, row)] if base == 0 else []
        for level in range(base + 1, min(base + levels, height(n)) + 1):
            row = [digest("".join(row[i : i + 2])) for i in range(0, len(row), 2)]
            first >>= 1
            out.append((level, first, row))
        at = [(level, first + i, h) for level, first, row in out for i, h in enumerate(row)]
        made = pd.DataFrame(at, columns=["level", "idx", "hash"])
        return made.assign(tree=tree, n=n)[["tree", "n", "level", "idx", "hash"]]

    return run


def build(bottom: DataFrame, levels: int, scratch) -> DataFrame:
    """All nodes (tree, level, idx, hash) over the nodes (tree, n, idx, hash) of level 0."""
    made, base = None, 0
    while True:
        block = F.shiftright("idx", levels).alias("block")
        step = bottom.select("tree", "n", "idx", "hash", block).groupBy("tree", "block")
        step = scratch.cut(step.applyInPandas(raised(base, levels), "tree long, n long, level int, idx long, hash string"), "nodes")
        made = step if made is None else made.unionByName(step)
        base += levels
        bottom = step.where((F.col("level") == base) & (F.col("n") > F.lit(2).cast("double") ** base)).drop("level")
        if bottom.isEmpty():
            return made.select("tree", "level", "idx", "hash", "n")


def manifest(rows: DataFrame, group: str, order: str, leaf: str, scratch, levels: int = LEVELS) -> Manifest:
    """The trees over ``rows``, whose column ``leaf`` is each row's digest."""
    filled = [F.col(group).isNotNull().alias("_some"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_name")]
    kind = rows.schema[order].dataType.simpleString()
    at = [F.col(order).isNotNull().alias("_there"), F.coalesce(F.col(order), F.lit("0" if kind != "string" else "").cast(kind)).alias("_at")]
    rows = scratch.cut(rows.select("*", *filled, *at).withColumn("_tie", F.monotonically_increasing_id()), "leaves")
    sizes = rows.groupBy("_some", "_name").agg(F.count(F.lit(1)).alias("n"))
    trees = in_order(sizes.withColumn("_all", F.lit(0)), ["_all"], ["_some", "_name"], "tree", scratch).drop("_all")
    n_trees = trees.count()
    ranked = in_order(rows, ["_some", "_name"], ["_there", "_at", leaf, "_tie"], "rank", scratch)
    leaves = ranked.join(trees, ["_some", "_name"]).drop("_some", "_name", "_there", "_at", "_tie")
    nodes = build(leaves.select("tree", "n", F.col("rank").alias("idx"), F.col(leaf).alias("hash")), levels, scratch)
    # a subroot is the only node of its tree's last level
    last = nodes.where((F.col("idx") == 0) & (F.lit(2).cast("double") ** F.col("level") >= F.col("n")))
    last = last.groupBy("tree").agg(F.min_by("hash", "level").alias("subroot"))
    trees = scratch.cut(trees.join(last, "tree").select("tree", "n", F.when(F.col("_some"), F.col("_name")).alias("name"), "subroot"), "trees")
    if not n_trees:
        return Manifest(leaves, nodes, trees, 0, None)
    tops = build(trees.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("idx"), F.col("subroot").alias("hash")), levels, scratch)
    root = tops.where((F.col("level") == height(n_trees)) & (F.col("idx") == 0)).first()["hash"]
    return Manifest(leaves, nodes.unionByName(tops).drop("n"), trees, n_trees, root)


def octopus(known: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Level by level the nodes that proofs of the leaves ``known`` (sorted, distinct) of ``n`` lack."""
    for level in range(height(n)):
        beside = known ^ 1
        yield level, np.setdiff1d(beside[beside < width(n, level)], known, assume_unique=True)
        known = np.unique(known >> 1)


def prove(made: Manifest, asked: DataFrame, leaf: str, claim: str, carried: list[str], levels: int = LEVELS) -> DataFrame:
    """(tree, rank, carried columns, proof, folded_root) of the rows ``asked`` (of ``made.leaves``):
    the siblings on a leaf's way to the root, one 64-digit digest after another from left to right
    of the way, and the root that the digest ``claim`` folds to with them."""
    n_trees = made.n_trees
    asked = asked.withColumn("_block", F.shiftright("rank", levels))

    def lacking(key, own):
        ways = [(key[0], np.unique(own["rank"].to_numpy(np.int64)), int(own["n"].iloc[0])), (TOP, np.array([key[0]]), n_trees)]
        need = [(of, level, int(i)) for of, known, n in ways for level, miss in octopus(known, n) for i in miss]
        out = pd.DataFrame(need, columns=["of", "level", "idx"])
        return out.assign(tree=key[0], _block=key[1])[["tree", "_block", "of", "level", "idx"]]

    need = asked.select("tree", "_block", "rank", "n").groupBy("tree", "_block")
    need = need.applyInPandas(lacking, "tree long, _block long, of long, level int, idx long")
    got = need.join(made.nodes.withColumnRenamed("tree", "of"), ["of", "level", "idx"])
    keep = [f.name for f in asked.schema if f.name in carried]
    kinds = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in keep)

    def expanded(key, own, fetched):
        if not len(own):
            return pd.DataFrame(columns=["tree", "rank", *keep, "proof", "folded_root"])
        tree, n = int(key[0]), int(own["n"].iloc[0])
        parts = {of: f for of, f in fetched.groupby("of")}

        def derived(of: int, start: dict, n: int) -> list[dict]:
            """Known nodes by level: fetched ones and the shared interiors."""
            rows = [dict(start)] + [{} for _ in range(height(n))]
            if of in parts:
                for level, i, h in zip(parts[of]["level"], parts[of]["idx"], parts[of]["hash"], strict=True):
                    rows[level][i] = h
            known = set(start)
            for level in range(height(n)):
                known = {i >> 1 for i in known}
                for i in known:
                    rows[level + 1][i] = digest(rows[level][2 * i] + rows[level].get(2 * i + 1, ""))
            return rows

        low = derived(tree, dict(zip(own["rank"].tolist(), own[leaf], strict=True)), n)
        high = derived(TOP, {tree: low[-1][0]}, n_trees)

        def climb(rows: list[dict], i: int, now: str) -> tuple[list[str], str]:
            beside = []
            for level in range(len(rows) - 1):
                if (other := rows[level].get(i ^ 1)) is not None:
                    beside.append(other)
                if now == rows[level][i]:  # an interior that is known already
                    now = rows[level + 1][i >> 1]
                else:
                    now = digest(now + (other or "") if i % 2 == 0 else other + now)
                i >>= 1
            return beside, now

        proofs, folded = [], []
        for i, now in zip(own["rank"].tolist(), own[claim], strict=True):
            a, now = climb(low, i, now)
            b, now = climb(high, tree, now)
            proofs.append("".join(a + b))
            folded.append(now)
        return own[["tree", "rank", *keep]].assign(proof=proofs, folded_root=folded)

    sent = asked.select("tree", "_block", "rank", "n", *dict.fromkeys([leaf, claim, *keep]))
    pairs = sent.groupBy("tree", "_block").cogroup(got.groupBy("tree", "_block"))
    return pairs.applyInPandas(expanded, f"tree long, rank long, {kinds}, proof string, folded_root string")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    other = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    more = [F.try_add("n_chars", F.lit(1)) if c == "n_chars" else F.col(c) for c in FIELDS]
    rows = docs.select("doc_id", "lang", leaf_digest(*map(F.col, FIELDS)).alias("leaf"), F.when(other, leaf_digest(*more)).alias("claim"))
    scratch = Scratch(spark)
    made = manifest(rows.withColumn("claim", F.coalesce("claim", "leaf")), "lang", "doc_id", "leaf", scratch)
    proved = prove(made, made.leaves, "leaf", "claim", ["doc_id", "leaf"])
    out = proved.join(made.trees.select("tree", "subroot"), "tree").select(
        "doc_id", "leaf", "subroot", F.lit(made.root).cast("string").alias("root"), F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
        F.coalesce(F.col("folded_root") == F.lit(made.root), F.lit(False)).alias("verified"),
    )
    out = cut(out, "proofs")
    scratch.clear()
    return out
