"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on random lines. A pair collides on a line when both lie within
``window`` of each other; vectors at the least cosine collide on a line with a known chance, so
the threshold is the largest count of ``projections`` lines that such a pair still reaches with
probability ``recall``. Pairs that reach it are verified by cosine in double precision.

Which pairs are counted: further lines cut the rows of a label into cells by their signs, in
several tables. A cell holds about ``cell_rows`` rows, and there are as many tables as it takes
for a pair at the least cosine to share a cell with probability ``recall`` (none but one for a
label of ``cell_rows``). Cells only partition: inside one, every line is sorted, the windows around
its rows generate pair keys, keys are counted, and only pairs whose count reaches the threshold are
verified. A pair that shares several cells counts in its first. With n rows a label, the bits of a cell
grow with log n and the tables with n to the power of 0.18 at a cosine of 0.93, so the work
grows with about n^1.2, not with its square. Equal vectors of a label are one, with a weight. Cells
over ``most_rows`` are dealt into blocks and compared block by block. Tasks return link counts
and a spanning forest, never pairs.

Edge cases: null labels, null, empty or zero vectors and vectors with null or non-finite
parts link with nothing; vectors of another length are compared among themselves; repeated
rows are vectors of their own; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm._common import Scratch, components, cut, table
from docmill.llm.simhash import forest


def calibrate(min_cosine: float, projections: int, recall: float, sigmas: float = 2.0) -> tuple[float, int]:
    """Window half-width and the least count of collisions."""
    window = sigmas * sqrt(2 - 2 * min_cosine)
    p = erf(sigmas / sqrt(2))
    tail, count = 0.0, projections
    while count > 0:
        tail += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if tail >= recall:
            break
        count -= 1
    return window, count


def lines(dim: int, projections: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed + dim).standard_normal((dim, projections))


def units(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors and the unit vectors in double precision."""
    x = np.array([np.asarray(v, np.float64) for v in values])
    norm = np.sqrt((x * x).sum(axis=1))
    ok = np.isfinite(norm) & (norm > 0)
    return np.flatnonzero(ok), x[ok] / norm[ok, None]


def collisions(p: np.ndarray, q: np.ndarray, window: float, same: bool) -> np.ndarray:
    """How often each pair key (i * len(q) + j) collides. On every line, the sorted rows of ``q`` inside
    the window around row i of ``p`` make its keys. With ``same`` (p is q) a row looks only
    ahead in the order, so a pair has one key, its smaller index first."""
    count = np.zeros(len(p) * len(q), np.uint16)
    for k in range(p.shape[1]):
        order = np.argsort(q[:, k], kind="stable")
        line = q[order, k]
        if same:
            asks, first, last = order, np.arange(1, len(q) + 1), np.searchsorted(line, line + window, "right")
        else:
            asks, first, last = np.arange(len(p)), *(np.searchsorted(line, p[:, k] + x, side) for x, side in ((-window, "left"), (window, "right")))
        width = last - first
        i = np.repeat(asks, width)
        j = order[np.arange(len(i)) + np.repeat(first - np.cumsum(width) + width, width)]
        count[np.minimum(i, j) * len(q) + np.maximum(i, j) if same else i * len(q) + j] += 1  # no key twice on a line
    return count


def cosines(ua: np.ndarray, ub: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (i ascending, j) of unit vectors, 128 rows of ``ua`` at a time."""
    out = np.zeros(len(i))
    for k in range(0, len(ua), 128):
        s = slice(*np.searchsorted(i, [k, k + 128]))
        a, b = i[s], j[s]
        if 8 * len(a) > 128 * len(ub):
            out[s] = (ua[k : k + 128] @ ub.T)[a - k, b]
        elif len(a):
            out[s] = np.einsum("ij,ij->i", ua[a], ub[b])
    return out


def plan_cells(n: int, min_cosine: float, recall: float, cell_rows: int) -> tuple[int, int]:
    """Bits of a cell and number of tables for ``n`` rows."""
    bits = min(24, max(0, ceil(log2(max(n, 1) / cell_rows))))
    together = (1 - acos(min_cosine) / pi) ** bits
    return bits, 1 if not bits else ceil(log(1 - recall) / log(1 - together))


def cell_codes(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The cell of each row in each table."""
    if not bits:
        return np.zeros((len(unit), tables), np.int64)
    side = unit @ lines(unit.shape[1], bits * tables, 23) > 0
    return side.reshape(len(unit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def link_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    min_cosine: float = 0.93,
    projections: int = 24,
    recall: float = 0.99999,
    cell_rows: int = 128,
    most_rows: int = 2048,
) -> DataFrame:
    """(id, n_links, component_id) of every row."""
    kind = vectors.schema[id_col].dataType.simpleString()
    window, least = calibrate(min_cosine, projections, recall)
    wide = "float" if "float" in vectors.schema[vector_col].dataType.simpleString() else "double"
    number = np.float32 if wide == "float" else np.float64
    source = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{wide}>").alias("v"))
    source = cut(source.withColumn("row", F.monotonically_increasing_id()), "vectors")
    scratch = Scratch(vectors.sparkSession)
    usable = source.where("label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    usable = usable.where("exists(v, x -> x <> 0)")
    usable = usable.withColumn("grp", F.concat_ws(":", F.size("v"), "label")).withColumns({f"h{k}": F.xxhash64(F.lit(k), "v") for k in (0, 1)})
    twins = scratch.cut(usable.groupBy("grp", "h0", "h1").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("weight")), "twins")
    alone = usable.join(twins, ["grp", "h0", "h1"])
    of_row = scratch.cut(alone.select("row", "rep"), "reps")
    reps = scratch.cut(alone.where("row = rep").select("row", "grp", "v", "weight"), "distinct")
    sizes = reps.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"))

    def deal(with_v: bool):
        def run(batches):
            for b in batches:
                for (_, rows), part in b.groupby([b["v"].map(len), b["rows"]]):
                    at, unit = units(part["v"])
                    part = part.iloc[at]
                    bits, tables = plan_cells(int(rows), min_cosine, recall, cell_rows)
                    codes = cell_codes(unit, bits, tables)
                    raw = [np.asarray(v, number).tobytes() for v in part["v"]] if with_v else None
                    for t in range(tables):
                        one = {"grp": part["grp"], "t": np.int32(t), "cell": codes[:, t], "rows": rows}
                        yield pd.DataFrame(one | ({"row": part["row"], "weight": part["weight"], "v": raw} if with_v else {}))

        return run

    dealt = reps.join(sizes, "grp")
    cell = "grp string, t int, cell long, rows long"
    counts = dealt.mapInPandas(deal(False), cell).groupBy("grp", "t", "cell").agg(F.count(F.lit(1)).alias("n"))
    big = scratch.cut(counts.where(F.col("n") > most_rows), "big_cells")
    placed = dealt.mapInPandas(deal(True), f"{cell}, row long, weight long, v binary")

    def unpack(raw) -> np.ndarray:
        x = np.frombuffer(b"".join(raw), number).reshape(len(raw), -1).astype(np.float64)
        return x / np.sqrt((x * x).sum(axis=1))[:, None]

    def links(ua, ub, rows: int, t: int, same: bool):
        """Positions of linked pairs that share no cell of an earlier table."""
        to = lines(ua.shape[1], projections)
        pa, pb = ua @ to, ub @ to
        plan = plan_cells(rows, min_cosine, recall, cell_rows)
        ca, cb = (cell_codes(u, *plan)[:, :t] for u in (ua, ub))
        out = []
        for k in range(0, len(ua), len(ua) if same else 256):
            a = slice(None) if same else slice(k, k + 256)
            i, j = np.divmod(np.flatnonzero(collisions(pa[a], pb, window, same) >= least), len(ub))
            keep = cosines(ua[a], ub, i, j) >= min_cosine
            i, j = i[keep] + k, j[keep]
            new = np.ones(len(i), bool)
            for c in range(t):
                new &= ca[i, c] != cb[j, c]
            out.append((i[new], j[new]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def found(rows, weight, i, j):
        """Links (as weights) and a forest of the rows at i and j."""
        n = np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
        own = np.flatnonzero(n)
        return pd.DataFrame({"row": rows[own], "n": n[own].astype(np.int64), "root": rows[forest(len(rows), i, j)[own]]})

    def small_cells(key, pdf):
        out = []
        for _, own in pdf.groupby("cell"):
            if len(own) > 1:
                u = unpack(own["v"])
                out.append(found(own["row"].to_numpy(), own["weight"].to_numpy(), *links(u, u, int(own["rows"].iloc[0]), int(key[1]), True)))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "n": [], "root": []})

    shape = "row long, n long, root long"
    # about sixteen cells a group: they share the cost of a group, and of sorting by cell
    several = F.pmod(F.xxhash64("cell"), F.greatest(F.lit(1), F.col("rows") / (16 * cell_rows)).cast("long")).alias("bucket")
    rest = placed.join(big.select("grp", "t", "cell"), ["grp", "t", "cell"], "left_anti")
    pieces = rest.select("*", several).groupBy("grp", "t", "bucket").applyInPandas(small_cells, shape)

    def pack(key, pdf):
        one = {"grp": key[0], "t": key[1], "cell": key[2], "part": key[3], "group_rows": pdf["rows"].iloc[0]}
        return pd.DataFrame([one | {"rows": pdf["row"].to_numpy(np.int64).tobytes(), "weight": pdf["weight"].to_numpy(np.int64).tobytes(), "v": b"".join(pdf["v"]), "dim": len(pdf["v"].iloc[0])}])

    def compare(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                ra, rb = np.frombuffer(r.rows, np.int64), np.frombuffer(r.rows2, np.int64)
                wa, wb = np.frombuffer(r.weight, np.int64), np.frombuffer(r.weight2, np.int64)
                ua, ub = (unpack([v[k : k + r.dim] for k in range(0, len(v), r.dim)]) for v in (r.v, r.v2))
                same = r.part == r.part2
                i, j = links(ua, ub, r.group_rows, r.t, same)
                yield found(ra, wa, i, j) if same else found(np.concatenate([ra, rb]), np.concatenate([wa, wb]), i, j + len(ra))

    if not big.isEmpty():
        parts = big.select("grp", "t", "cell", F.ceil(F.col("n") / most_rows).cast("int").alias("parts"))
        blocks = placed.join(parts, ["grp", "t", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
        block = "grp string, t int, cell long, part int, group_rows long, rows binary, weight binary, v binary, dim int"
        blocks = scratch.cut(blocks.groupBy("grp", "t", "cell", "part").applyInPandas(pack, block), "blocks")
        other = blocks.select("grp", "t", "cell", *[F.col(c).alias(f"{c}2") for c in ("part", "rows", "weight", "v")])
        tiles = blocks.join(other, ["grp", "t", "cell"]).where("part <= part2")
        pieces = pieces.unionByName(tiles.mapInPandas(compare, shape))
    pieces = scratch.cut(pieces, "found")
    counts = pieces.groupBy(F.col("row").alias("rep")).agg(F.sum("n").alias("n"))
    labels = components(pieces.where("row <> root"), "row", "root", scratch.cut).withColumnRenamed("node", "rep")
    tied = of_row.join(twins.select("rep", "weight"), "rep").join(labels, "rep", "left").join(counts, "rep", "left")
    tied = tied.select("row", F.coalesce("label", "rep").alias("label"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    named = source.select("row", "_id").join(tied, "row", "left")
    named = cut(named.select("row", "_id", F.coalesce("label", "row").alias("label"), "n_links"), "named")
    scratch.clear()
    least_id = named.groupBy("label").agg(F.min("_id").alias("component_id"))
    out = named.join(least_id, "label")
    return out.select(F.col("_id").cast(kind).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")


def op7_vectors(spark, sf_dir):
    out = link_vectors(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
