"""The positional index against plain matching of windows."""

import random
import re

import pytest

from docmill.llm import phrases
from docmill.llm._common import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, size):
    out = []
    for i, t in docs:
        ws, hit, names = words(t), set(), set()
        for name, text in items:
            iw = words(text)
            n = min(size, len(iw))
            wins = {tuple(iw[s : s + n]) for s in range(len(iw) - n + 1)} if iw else set()
            for s in range(len(ws) - n + 1) if wins else ():
                if tuple(ws[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    names.add("" if name is None else str(name))
        out.append((i, len(ws), len(hit), sorted(names), bool(hit)))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice(["a", "b", "É", "é", "Straße", "X1", "x1", "I", "İ", "c-d"]) for _ in range(n))
    items = [(1, "a b. A, b! É"), (2, "X1"), (3, None), (4, ""), (5, some(12)), (None, "a a a"), (5, some(3)), (7, "... --"), (8, "never \U0001f600 seen"), (9, "b b")]
    docs = [(i, some(rng.choice([0, 1, 3, 40, 200]))) for i in range(40)]
    docs += [(None, "a b a B É"), (3, docs[3][1]), (3, docs[3][1]), (50, None), (51, ""), (52, "x1"), (53, "!?"), (54, "a a " * 5000), (55, "zz " + items[4][1] + " zz")]
    return docs, items


@pytest.mark.parametrize("most", [1_000_000, 0])  # broadcast, or shuffled throughout
@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_windows(spark, monkeypatch, most, size):
    monkeypatch.setattr(phrases.small, "__defaults__", (most,))
    monkeypatch.setattr(phrases.phrase_matches, "__defaults__", (most,))
    docs, items = texts(size)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_hit string")
    out = phrases.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"), size=size)
    assert out.columns[:3] == ["doc_id", "text", "n_hit"] and len(set(map(str.lower, out.columns))) == 7
    got = sorted(((r["doc_id"], r["n_words"], r[out.columns[4]], r["items"], r["contaminated"]) for r in out.collect()), key=str)
    assert got == plain(docs, items, size)


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert phrases.decontaminate(d, i).count() == 0
    out = phrases.decontaminate(i.withColumnRenamed("item_id", "doc_id"), i.limit(0)).collect()
    assert [(r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in out] == [(2, 0, [], False)]


def test_proximity(spark):
    docs = [("d0", "q a w e b r c t"), ("d1", "a x x x x x b x c"), ("d2", "c b a c b"), ("d3", "a b"), ("d4", "c a a a b")]
    d = spark.createDataFrame(docs, "doc_id string, text string")
    items = spark.createDataFrame([(1, "a b c"), (2, "T"), (3, "zebra a")], "item_id long, text string")
    scratch = Scratch(spark)
    index = scratch.cut(phrases.build_index(d))
    keys = {(r["k1"], r["k2"]): r["doc_id"] for r in d.select("doc_id", *phrases.text_key(d["text"])).collect()}
    got = {(keys[r["k1"], r["k2"]], r["item"], r["start"], r["end"]) for r in phrases.proximity_matches(index, items, "item_id", "text", scratch, 3, 6).collect()}
    want = set()
    for i, t in docs:
        ws = words(t)
        for item, asked in ((1, "abc"), (2, "t")):
            for end in range(len(ws)):
                lasts = [max((p for p in range(end + 1) if ws[p] == w), default=None) for w in asked]
                if ws[end] in asked and None not in lasts and end - min(lasts) < 6:
                    want.add((i, str(item), min(lasts), end))
    assert got == want and len(want) > 5
    scratch.clear()
