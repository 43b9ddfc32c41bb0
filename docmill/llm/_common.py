"""Helpers that the operators of this subpackage share: written cuts, ranks and prefix sums
that no hot group can break, and connected components without a driver-side graph."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder (``spark.checkpoint.dir``). Where it is unset a local
    master gets a folder of its own; executors of a cluster could not share one, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="docmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it can be removed when the application ends."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later jobs start from
    the files, so neither a lost executor nor a second use computes it again. Results read these
    files, so they stay until whoever has consumed the results removes ``scratch_dir``."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_BYTES, BATCH_MAX = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches to Python end at ``BATCH_MAX`` bytes, unless it has a
    limit of its own. 10,000 rows of long texts otherwise take their bytes several times over in
    the executor's JVM and again in each Python worker. No row is left out: a longer one is a batch."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(BATCH_MAX))


HELD: dict = {}


def give_back() -> None:
    """What this Python worker has freed goes back to the system. Its allocators would keep it, and
    a worker that waits for its next task keeps it while the executor's JVM works."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def lean(run):
    """``run`` (batches in, batches out) that gives back after each batch and when the task ends."""

    def each(batches):
        for b in batches:
            yield b
            del b
            give_back()

    def whole(batches):
        yield from run(each(batches))
        give_back()

    return whole


def let_go() -> None:
    """For tasks that remember nothing: what the worker holds goes."""
    if HELD:
        HELD.clear()
        give_back()


def held(key, make):
    """What ``make`` returned for ``key`` in this Python worker, which outlives its tasks. A worker
    holds one such object at a time, so no stage carries what an earlier one has remembered."""
    if key not in HELD:
        let_go()
        HELD[key] = make()
    return HELD[key]


LAST_EDGES = 100_000


class Scratch:
    """Written tables that a computation needs only until its result is written itself: ``clear``
    empties their folder, so they take no room while later steps run."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{scratch_dir(spark)}/part-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame, name: str = "cut") -> DataFrame:
        self.n += 1
        path = f"{self.path}/{name}-{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        if self.n:
            self.spark.range(0).write.mode("overwrite").parquet(self.path)


class WordHashes:
    """64-bit hashes of a text's words (runs of anything but ASCII white space, A-Z in lower
    case); remembers words."""

    CACHED = 150_000

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(self.known) > self.CACHED:
            self.known = {}
        known, digest = self.known, xxhash.xxh64_intdigest
        for w in set(words).difference(known):
            known[w] = digest(w, 42)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str = "rows") -> tuple[DataFrame, str]:
    """``df`` written with a number for each row, and that column's name: rows can then be told
    apart whatever their ids are."""
    row = free_name(df, "_row")
    return cut(df.withColumn(row, F.monotonically_increasing_id()), name), row


def row_keys(df: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """``df`` with two 64-bit hashes of each whole row, and their names. Rows with equal keys are
    equal in every column, so it does not matter which of them a step keeps."""
    names = free_name(df, "_row"), free_name(df, "_row_too")
    cols = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    nulls = [c.isNull() for c in cols]  # hashes pass over nulls
    return df.withColumns({n: F.xxhash64(F.lit(k), *cols, *nulls) for k, n in enumerate(names)}), names


def prefix(
    df: DataFrame,
    groups: list[str],
    order: list[str],
    rank: str | None = None,
    weight: str | None = None,
    before: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add a gapless 0-based rank and/or the sum of ``weight`` over the rows ahead, per group.

    A group may hold any share of all rows: each is dealt by a hash of ``order`` into about
    sqrt(rows) buckets. Bucket totals (partial aggregation) give each bucket's start; one
    window inside (group, bucket) gives the rest. The rank follows (bucket, order): it is
    fixed by the rows, but it is not the sort order of ``order``. ``rows`` saves a count.
    Columns of ``groups`` hold no nulls: callers fill them first.
    """
    n = df.count() if rows is None else rows
    buckets = max(1, round(n**0.5))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    keys = [*groups, "_bucket"]
    totals = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(weight) if weight else F.lit(0)).alias("_w")
    )
    ahead = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys,
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_w0"),
    )
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.join(starts, keys)
    made = {}
    if rank:
        made[rank] = F.col("_n0") + F.row_number().over(w) - 1
    if before:
        made[before] = F.col("_w0") + F.coalesce(
            F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
    return out.withColumns(made).drop("_bucket", "_n0", "_w0")


def components(links: DataFrame, a: str, b: str, cut=cut) -> DataFrame:
    """(node, label) for each node of ``links``; equal labels: connected. Labels are nodes.

    Each round every node steps to the neighbour (or itself) that a hash puts first and the
    edges are contracted, so a chain shrinks by a constant factor as a star does. Rounds join
    written tables, whose skewed sides Spark can split; nothing is collected. What contraction
    has left at ``LAST_EDGES`` edges one task finishes.
    """
    e = cut(
        links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges"
    )
    labels = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct()
    labels = labels.withColumn("label", F.col("node"))
    k = 0
    while (n := e.count()) > LAST_EDGES:
        k += 1
        turn = F.lit(k)
        both = e.union(e.select("v", "u")).toDF("u", "v")
        first = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", turn), "v")).alias("m"))
        own = F.struct(F.xxhash64("u", turn), F.col("u").alias("v"))
        step = cut(first.select("u", F.least("m", own)["v"].alias("to")), "step")
        at = lambda c: step.select(F.col("u").alias(c), F.col("to").alias(f"{c}_to"))
        e = cut(
            e.join(at("u"), "u")
            .join(at("v"), "v")
            .select(F.greatest("u_to", "v_to").alias("u"), F.least("u_to", "v_to").alias("v"))
            .where("u <> v")
            .distinct(),
            "edges",
        )
        labels = labels.join(at("label"), "label", "left").select(
            "node", F.coalesce("label_to", "label").alias("label")
        )
        if k % 3 == 0:  # keeps the plan of the labels short
            labels = cut(labels, "labels")
    if n:
        last = cut(e.coalesce(1).mapInPandas(_finish, "label long, label_to long"), "last")
        labels = labels.join(last, "label", "left").select("node", F.coalesce("label_to", "label").alias("label"))
    return labels


def _finish(batches):
    """(label, label_to) of the nodes of at most ``LAST_EDGES`` edges (u, v)."""
    parts = [b[["u", "v"]].to_numpy(np.int64) for b in batches]
    if parts:
        nodes, back = np.unique(np.concatenate(parts), return_inverse=True)
        u, v = back.reshape(-1, 2).T
        root = np.arange(len(nodes))
        while (apart := root[u] != root[v]).any():
            a, b = root[u][apart], root[v][apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
        yield pd.DataFrame({"label": nodes, "label_to": nodes[root]})
