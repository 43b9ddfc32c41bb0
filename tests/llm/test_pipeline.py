"""Stages act on rows: null ids, ids that texts share, clashing names, empty tables; and the
whole pipeline against a plain version of each stage."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docmill.llm import mixing, packing, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"
RNG = random.Random(9)
WORDS = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in "nrst"]
TEXT = {k: " ".join(RNG.choice(WORDS) for _ in range(60)) for k in "ABCDE"}
SCHEMA = "doc_id long, text string, source string, _row int, _block string, _check int, label int, n_chars int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "u", 9, None, len(t or "")) for i, t, s in rows], SCHEMA)


def test_one_row_of_each_class(spark):
    near = TEXT["A"].replace(TEXT["A"].split()[30], "changed", 1)
    rows = [(3, TEXT["B"], "s"), (5, TEXT["A"], "s"), (5, TEXT["B"], "s"), (6, TEXT["A"], "s"), (9, near, "t")]
    rows += [(None, TEXT["C"], "s"), (None, TEXT["C"], "s"), (8, TEXT["C"], "t"), (None, TEXT["D"], None), (4, None, "s"), (4, None, "s"), (7, "", "s"), (8, " ", "s")]
    docs = frame(spark, rows)
    out = simhash.keep_one(docs)
    assert out.schema == docs.schema
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(3, TEXT["B"]), (5, TEXT["A"]), (8, TEXT["C"]), (None, TEXT["D"]), (4, None), (4, None), (7, "")], key=str)
    assert {(r["_row"], r["_block"], r["_check"]) for r in out.collect()} == {(7, "u", 9)}
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_each_draw_is_a_row_in_the_order_of_the_mixture(spark):
    rows = [(k, TEXT["A"] + f" {k}", "a") for k in range(12)] + [(None, TEXT["B"], "b"), (1, TEXT["C"], "b"), (1, TEXT["C"], "b")]
    docs = frame(spark, rows)
    for options in ({}, {"cover": True}, {"budget": 400}):
        drawn = mixing.mix(docs, **options).collect()
        out = mixing.mixed_rows(docs, **options)
        assert out.schema == docs.schema and {(r["_row"], r["_block"], r["_check"]) for r in out.collect()} == {(7, "u", 9)}
        same = lambda rows: Counter((r["doc_id"], zlib.crc32(r["text"].encode()) if "text" in r else r["check"]) for r in rows)
        assert same([r.asDict() for r in out.collect()]) == same([r.asDict() for r in drawn])
        assert [r["doc_id"] for r in out.collect()] == [r["doc_id"] for r in sorted(drawn, key=lambda r: (r["block"], r["turn"]))] or len(drawn) != len({(r["block"], r["turn"]) for r in drawn})
    assert {(r["doc_id"], r["text"]) for r in mixing.mixed_rows(docs, cover=True).collect()} == {(i, t) for i, t, _ in rows}


def test_toxic_rows_go_by_their_text(spark):
    mild = ["a calm walk by the river", "tea and bread in the morning", "the train was late again"]
    rows = [(i, f"{mild[i % 3]} {i}" if i % 2 else f"you vile grubnak, you zorbish grubnak {i}", "s") for i in range(200)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, toxic int")
    extra = [(1, "you vile grubnak, you zorbish grubnak 7", "s"), (None, "you vile grubnak, you zorbish grubnak 8", "s"), (None, mild[0], "s"), (2, mild[1], "s"), (300, None, None)]
    docs = frame(spark, rows + extra)
    out = sorted(((r["doc_id"], r["text"]) for r in toxicity.drop_toxic(docs, labels, min_docs=2).collect()), key=str)
    assert out == sorted([(i, t) for i, t, _ in rows if i % 2] + [(None, mild[0]), (2, mild[1]), (300, None)], key=str)


def shingle_set(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def test_stages_against_plain_versions(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    labels = corpus_pipeline.table(spark, SF, "labels")
    state, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        state = corpus_pipeline.cut(stage(spark, state, SF), f"test-{name}")
        kept[name] = [r.asDict() for r in state.collect()]
        if name != "packing":
            assert state.columns == docs.columns
    before = [r.asDict() for r in docs.collect()]
    rejected = {r["doc_id"] for r in toxicity.score_toxicity(docs, labels).where("predicted = 1").collect()}
    key = lambda r: (r["doc_id"], r["text"])
    assert sorted(map(key, kept["toxicity"])) == sorted(key(r) for r in before if r["doc_id"] not in rejected)
    own = {r["doc_id"]: shingle_set(r["text"] or "") for r in kept["toxicity"]}
    ids, label = sorted(own), {i: i for i in own}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert sorted(r["doc_id"] for r in kept["near_duplicates"]) == sorted(set(label.values()))
    for was, now in zip(sorted(kept["near_duplicates"], key=key), sorted(kept["secrets"], key=lambda r: r["doc_id"]), strict=True):
        spans, text, at, out = secrets.scan_segment([was["text"]])[0], was["text"], 0, []
        for s, _, e in spans:
            out, at = ([*out, text[at:s], "[SECRET]"], e) if s >= at else (out, max(at, e))
        assert now["text"] == "".join([*out, text[at:]]) and now["n_chars"] == len(now["text"])
    worded = Counter(r["doc_id"] for r in kept["secrets"] if r["text"].split())
    drawn = Counter(r["doc_id"] for r in kept["mixing"])
    assert set(drawn) == set(worded) and max(drawn.values()) > 1
    got = Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in kept["packing"])
    encode, want = packing.encoder(packing.public_tokenizer()), Counter()
    for r in kept["mixing"]:
        coded = np.append(np.frombuffer(encode([r["text"]])[0], "<u4"), 0).astype("<u4")
        for k in range(0, len(coded), 2048):
            want[r["doc_id"], k // 2048, len(coded[k : k + 2048]), zlib.crc32(coded[k : k + 2048].tobytes())] += 1
    assert got == want


def test_empty_tables(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    for empty in (docs.limit(0), docs.where("doc_id < 0").withColumn("_row", F.lit(1))):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, empty, SF).count() == 0, name


@pytest.mark.parametrize("column", ["text", "source", "doc_id"])
def test_null_columns(spark, column):
    docs = frame(spark, [(i, TEXT["ABCDE"[i % 5]] + f" {i // 5}", "ab"[i % 2]) for i in range(15)])
    docs = docs.withColumn(column, F.lit(None).cast(docs.schema[column].dataType))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        if column != "text" or stage is not corpus_pipeline.mix_sources:
            assert out.count() > 0
    corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
