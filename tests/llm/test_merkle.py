"""Trees, proofs and multiproofs against a plain tree."""

from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import merkle
from docmill.llm._common import Scratch


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_levels(leaves):
    rows = [list(leaves)]
    while len(rows[-1]) > 1:
        rows.append([h(*rows[-1][i : i + 2]) for i in range(0, len(rows[-1]), 2)])
    return rows


def plain_proof(rows, i):
    out = []
    for row in rows[:-1]:
        if (i ^ 1) < len(row):
            out.append(row[i ^ 1])
        i >>= 1
    return out


ROWS = [(k, lang, f"t{k}") for lang, n in (("aa", 1), ("b", 2), ("ü", 37), (None, 5), ("", 3)) for k in range(n)]
ROWS += [(None, "b", "none"), (None, "b", "none"), (7, "ü", "again"), (7, "ü", "t7"), (7, "ü", "t7"), (9, "ü", None), (9, "ü", "")]


@pytest.mark.parametrize("levels", [1, 2, 3, 12])
def test_manifest_and_proofs(spark, levels):
    df = spark.createDataFrame(ROWS, "k long, lang string, text string").repartition(5)
    df = df.withColumn("leaf", merkle.leaf_digest(F.col("k"), F.col("text")))
    scratch = Scratch(spark)
    made = merkle.manifest(df, "lang", "k", "leaf", scratch, levels)
    form = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    own = {}
    for k, lang, text in ROWS:
        own.setdefault(lang, []).append((k is not None, k or 0, h(form(k), form(text))))
    names = sorted(own, key=lambda x: (x is not None, (x or "").encode()))
    trees = [plain_levels([x[2] for x in sorted(own[name])]) for name in names]
    top = plain_levels([t[-1][0] for t in trees])
    assert made.root == top[-1][0] and made.n_trees == 5
    assert {(r["name"], r["subroot"]) for r in made.trees.collect()} == {(n, t[-1][0]) for n, t in zip(names, trees, strict=True)}
    for some in (F.lit(True), F.col("rank") % 3 == 1, F.col("k").isNull()):
        asked = made.leaves.where(some).withColumn("claim", F.when(F.col("k") == 9, F.lit(h("x"))).otherwise(F.col("leaf")))
        out = merkle.prove(made, asked, "leaf", "claim", ["k", "leaf"], levels).collect()
        assert len(out) == asked.count() > 0
        for r in out:
            rows = trees[r["tree"]]
            assert rows[0][r["rank"]] == r["leaf"]
            assert r["proof"] == "".join(plain_proof(rows, r["rank"]) + plain_proof(top, r["tree"]))
            assert (r["folded_root"] == made.root) == (r["k"] != 9)
    scratch.clear()


def test_octopus_is_minimal():
    for n in (1, 2, 5, 8, 13):
        rows = plain_levels([str(i) for i in range(n)])
        for mask in range(1, 2**n):
            known = np.array([i for i in range(n) if mask >> i & 1])
            need = {(level, int(i)) for level, miss in merkle.octopus(known, n) for i in miss}
            wanted, have = set(), [set(known.tolist())]
            for level in range(len(rows) - 1):
                wanted |= {(level, i ^ 1) for i in have[level] if (i ^ 1) < len(rows[level])}
                have.append({i >> 1 for i in have[level]})
            assert need == {(level, i) for level, i in wanted if i not in have[level]}


def test_empty_and_single(spark):
    scratch = Scratch(spark)
    df = spark.createDataFrame([(1, "a", "leaf")], "k long, lang string, leaf string")
    none = merkle.manifest(df.limit(0), "lang", "k", "leaf", scratch)
    assert none.root is None and none.n_trees == 0 and none.leaves.count() == 0
    one = merkle.manifest(df, "lang", "k", "leaf", scratch)
    out = merkle.prove(one, one.leaves, "leaf", "leaf", ["k"]).collect()
    assert [(r["proof"], r["folded_root"]) for r in out] == [("", "leaf")] and one.root == "leaf"
    scratch.clear()
