"""An approximate vector index of inverted-file cells, beside the exact ``retrieve.vector_topk``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.words import ranked
from docmill.operators.retrieve import best_of_block


def _nearest(centroids: np.ndarray, n: int):
    """A pandas UDF: the numbers of the ``n`` nearest centroids of a vector, nearest first."""
    half = (centroids**2).sum(axis=1) / 2

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        far = half - np.stack(v.to_list()).astype(np.float64) @ centroids.T
        return pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return nearest


def build_cells(vectors: DataFrame, path: str, n_cells: int, sample: int = 100_000, seed: int = 7) -> None:
    """Write ``vectors`` (chunk_id, v and further columns, such as a scope) under ``path`` in folders of
    cells. The cells' centres are fitted on a sample of about ``sample`` vectors; every vector is put
    into the cell of its nearest centre. Null vectors are left out."""
    whole = vectors.where("v is not null and size(v) > 0")
    share = min(1.0, sample / max(1, whole.count()))
    fit = (whole if share == 1.0 else whole.sample(share, seed)).select(array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("features"))
    made = KMeans(k=n_cells, seed=seed, maxIter=15).fit(fit)
    centroids = np.array(made.clusterCenters())  # at most n_cells of them
    spark = vectors.sparkSession
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
    placed = whole.withColumn("cell", F.get(_nearest(centroids, 1)("v"), F.lit(0)))
    placed.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/lists")


def cell_topk(spark: SparkSession, path: str, queries: DataFrame, top_k: int = 10, probes: int = 8, scope: list[str] | None = None, block_rows: int = 65_536, query_rows: int = 8192) -> DataFrame:
    """(query_id, chunk_id, rank, score): the nearest stored vectors by inner product among those of the ``probes``
    nearest cells of each query (query_id, q). With ``scope`` only vectors that equal the query in these
    columns are compared. Cells that no query asks for are not read; a long cell is dealt into blocks, and
    so are many queries, so a task holds a block of each."""
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # as many as there are cells
    centroids = np.array([r["centre"] for r in centres])
    asked = queries.where("q is not null").withColumn("cell", F.explode(_nearest(centroids, probes)("q")))
    wanted = sorted(r["cell"] for r in asked.select("cell").distinct().collect())
    lists = spark.read.parquet(f"{path}/lists").where(F.col("cell").isin(wanted))
    keys = ["cell", *(scope or []), "_block", "_ask"]
    n_asks = max(1, -(-queries.count() // query_rows))
    sizes = lists.groupBy(*keys[:-2]).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int").alias("_n"))
    own = lists.join(sizes, keys[:-2]).withColumn("_block", F.pmod(F.xxhash64("chunk_id"), F.col("_n")).cast("int"))
    own = own.withColumn("_ask", F.explode(F.sequence(F.lit(0), F.lit(n_asks - 1))))
    asked = asked.join(sizes, keys[:-2]).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    asked = asked.withColumn("_ask", F.pmod(F.xxhash64("query_id"), F.lit(n_asks)).cast("int"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (lists, "chunk_id"))]

    pairs = own.select(*keys, "chunk_id", "v").groupBy(*keys).cogroup(asked.select(*keys, "query_id", "q").groupBy(*keys))
    pairs = pairs.applyInPandas(best_of_block(top_k), f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
    return pairs.withColumn("rank", ranked(["query_id"], F.desc("score"), F.asc("chunk_id"))).where(F.col("rank") <= top_k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the exact hits that are found."""
    hit = found.select("query_id", "chunk_id", F.lit(1).alias("_hit")).distinct()
    both = exact.select("query_id", "chunk_id").join(hit, ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))
