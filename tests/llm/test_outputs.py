"""Operators give texts and token ids, not only counts of them."""

import zlib

import numpy as np

from docmill.llm import linefreq, packing


def test_frequent_lines_leave_the_text(spark):
    own = lambda i: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(i, f"Share This Page {i}\n{own(i)}\n\n***\nshare this page 7", "h", i) for i in range(40)]
    rows += [(100, "Share this page 1\ntoo short", "h", 0), (None, own(999), None, 1), (5, f"{own(5)}\nkept as it is", "other", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    out = {(r["doc_id"], r["source"]): r["text"] for r in linefreq.clean_documents(docs.withColumnRenamed("row", "n")).collect()}
    letters = lambda i: f"{own(i)}\n\n***"
    assert out == {(i, "h"): letters(i) for i in range(40)} | {(None, None): own(999), (5, "other"): rows[-1][1]}


def test_sequences_can_be_built(spark):
    rows = [(i, " ".join(f"word{k * i % 97}" for k in range(i * 7 % 150))) for i in range(60)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = {}
    for r in packing.pack_documents(docs, capacity=64).collect():
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        made.setdefault(r["sequence_id"], []).append((r["offset"], r["doc_id"], r["piece"], ids))
    texts = {}
    for parts in made.values():
        parts.sort(key=lambda x: x[0])
        assert [p[0] for p in parts] == np.cumsum([0, *[len(p[3]) for p in parts[:-1]]]).tolist()
        texts |= {(p[1], p[2]): p[3] for p in parts}
    encode = packing.encoder(packing.public_tokenizer())
    for i, text in rows:
        want = np.append(np.frombuffer(encode([text])[0], "<u4"), 0)
        got = np.concatenate([texts[k] for k in sorted((k for k in texts if k[0] == i), key=lambda k: k[1])])
        assert got.tolist() == want.tolist()
