"""Ranked search against plain scoring of every row."""

import math
import random
import re
from collections import Counter

import pytest

from docmill.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def plain(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            s, n = 0, sum(c.values())
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // total)))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "Straße", "I", "İ", "\U0001f600"]
    some = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 66])]) for _ in range(n))
    docs = [(i, some(rng.choice([0, 1, 5, 30, 300]))) for i in range(150)]
    docs += [(None, some(9)), (None, None), (3, docs[3][1]), (500, docs[3][1]), (501, "W1 w1; W2"), (502, "w1 w1 w2"), (501, "W1 w1; W2"), (503, "only " * 3000), (504, "--")]
    docs += [(1000 + i, "same same text w3") for i in range(40)]
    items = [(i, some(rng.choice([1, 4, 25]))) for i in range(12)] + [(20, None), (21, "... "), (22, "never seen"), (None, "w1 W1 w2"), (5, "same"), (5, "Only W3"), (23, "É é")]
    return docs, items


@pytest.mark.parametrize(("k", "limits"), [(20, {}), (3, {"BLOCK": 4}), (5, {"MOST_TERMS": 20, "MOST_KEYS": 0})])
def test_ranks(spark, monkeypatch, k, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ranked, name, value)
    docs, items = texts(k)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, q int").repartition(3)
    out = ranked.search(d, spark.createDataFrame(items, "item_id long, text string"), "doc_id", "item_id", k=k)
    assert sorted(((r["item"], r["rank"], r["id"], r["score"]) for r in out.collect()), key=str) == plain(docs, items, k)


def test_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for x, y in ((d.limit(0), i), (d, i.limit(0)), (d.limit(0), i.limit(0)), (spark.createDataFrame([(1, None)], d.schema), i)):
        assert ranked.search(x, y, "doc_id", "item_id").count() == 0


def test_bounds_never_lie_below(spark):
    docs, items = texts(9)
    index = [r.asDict() for r in ranked.build_index(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    held = {(r["k1"], r["k2"]): Counter(ranked.terms(r["text"])) for r in ranked.keyed(spark.createDataFrame(docs, "doc_id long, text string"), "text").collect()}
    asked = ranked.Queries(list(enumerate(t for _, t in items)), sum(len(b["n"]) for b in index), sum(b["total"] for b in index))
    asked.weigh(Counter(t for c in held.values() for t in c))
    for block in index:
        bound = asked.bounds(block, ranked.Hashes()(asked.terms))
        for d, key in enumerate(zip(block["k1"], block["k2"], strict=True)):
            for q in range(len(asked.queries)):
                assert bound[q, d] >= asked.score(q, held[key], sum(held[key].values()))
