"""The pipeline's near-duplicates against all pairs."""

import random

import corpus_pipeline
from docmill.llm import jaccard


def made(n=30):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 200))]
        rows.append(text)
        for _ in range(rng.randrange(4)):
            copy = list(rows[-1])
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(copy)
        rows.append([*"the same long line of license text that is in all documents of the host".split(), *text[:12]])
    rng.shuffle(rows)
    return [(i, " ".join(r), "s") for i, r in enumerate(rows)]


def sets(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def test_all_pairs(spark):
    rows = made()
    own = [sets(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert got == dict(enumerate(label))
    assert len(set(label)) < len(rows) - 10


def test_stage_drops_copies_that_fingerprints_miss(spark):
    docs = spark.createDataFrame([*made(), (None, "no id", "s"), (900, None, "s"), (901, None, None)], "doc_id long, text string, source string")
    out = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    want = {r["component_id"] for r in jaccard.near_duplicates(docs).collect() if r["doc_id"] is not None}
    assert out == want | {None, 900, 901}
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_a_passage_too_rare_for_the_sample_makes_no_pairs_of_all_its_texts(spark, monkeypatch):
    rng = random.Random(11)
    text = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    passage = text(40)
    rows = [(i, f"{text(200)} {passage}" if i % 5 == 0 else text(240)) for i in range(600)]
    rows += [(600 + i, rows[i][1].replace(" u", " v", 3)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, cut = {}, jaccard.Scratch.cut

    def counted(self, df, name="cut"):
        out = cut(self, df, name)
        made[name] = made.get(name, 0) + (out.count() if name == "pairs" else 0)
        return out

    monkeypatch.setattr(jaccard.Scratch, "cut", counted)
    monkeypatch.setattr(jaccard, "SAMPLE", 6)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: i if i < 600 else i - 600 for i in range(640)}
    assert made["pairs"] < 1500  # 128 texts share the passage: 8,128 pairs
