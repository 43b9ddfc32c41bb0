"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form one group. Differencing keeps partial partitions into k subsets,
takes the two with the largest spread and merges them oppositely ordered, largest subset on
smallest, until one is left. It is sequential, so it runs in levels of bounded size: items of
at least 2/top_items of all bytes (at most top_items/2 of them) go up as they are; the others are dealt
by hash into buckets of about ``bucket_items``, each differenced into bucket_items/32 chunks
of near-equal size, and the chunks are the items of the next level. When at most
``top_items`` remain, a last differencing places them in the shards.

Edge cases: a null text counts as an empty one; ids may repeat; an empty table gives an empty
result; a group larger than a shard's share makes a larger shard; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm._common import cut, prefix, table


def difference(sizes: list[int], k: int) -> list[int]:
    """The subset, 0 to k-1, of each item by k-way largest differencing."""
    if not sizes:
        return []
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = s
        heap.append((-s, i, sums, (i, *[None] * (k - 1))))
    heapq.heapify(heap)
    while len(heap) > 1:  # sums fall from first to last and end in zero; subsets are pairs of pairs
        _, i, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        both = [p if q is None else q if p is None else (p, q) for p, q in zip(x, reversed(y), strict=True)]
        sums = sums[order] - sums[order[-1]]
        heapq.heappush(heap, (-int(sums[0]), i, sums, tuple(both[j] for j in order)))
    subset = [0] * len(sizes)
    for s, tree in enumerate(heap[0][3]):
        todo = [tree]
        while todo:
            t = todo.pop()
            if isinstance(t, tuple):
                todo += t
            elif t is not None:
                subset[t] = s
    return subset


def place_groups(groups: DataFrame, shards: int, bucket_items: int = 512, top_items: int = 8192) -> DataFrame:
    """(item, shard) of ``groups`` (item string, size long)."""
    spark, ways, steps = groups.sparkSession, max(1, bucket_items // 32), []
    base = items = cut(groups, "items")
    while True:
        n, total = items.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        if n <= top_items:
            break
        small = F.col("size") * (top_items // 2) < total
        buckets, level = -(-n // bucket_items), len(steps)

        def chunks(key, pdf):
            pdf = pdf.sort_values(["size", "item"])
            own = difference(pdf["size"].tolist(), ways)
            return pd.DataFrame({"item": pdf["item"], "size": pdf["size"], "up": [f"{level}:{key[0]}:{s}" for s in own]})

        dealt = items.where(small).withColumn("_b", F.pmod(F.xxhash64("item"), F.lit(buckets)))
        step = cut(dealt.groupBy("_b").applyInPandas(chunks, "item string, size long, up string"), "chunks")
        steps.append(step)
        up = step.groupBy(F.col("up").alias("item")).agg(F.sum("size").alias("size"))
        items = cut(items.where(~small).unionByName(up), "items")
    top = items.orderBy("item").toPandas()
    placed = list(zip(top["item"], difference(top["size"].tolist(), shards), strict=True))
    out = spark.createDataFrame(placed, "item string, shard int")
    for step in reversed(steps):
        low = step.join(out.withColumnRenamed("item", "up"), "up").select("item", "shard")
        out = out.unionByName(low)
    return base.select("item").join(out, "item") if steps else out


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): near-equal bytes a shard, equal texts together."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text, 256).alias("item"),
        ),
        "sizes",
    )
    groups = rows.groupBy("item").agg(F.sum("size").alias("size"))
    placed = cut(place_groups(groups, shards), "placed")
    out = cut(rows.join(placed, "item").select(id_col, "size", "text_crc32", "shard"), "sharded")
    return prefix(out, ["shard"], [id_col, "text_crc32", "size"], rank="slot")


def op6_sharding(spark, sf_dir):
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
