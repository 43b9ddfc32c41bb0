"""What Python workers hold: bounded batches, and one remembered object at a time."""

import gc
import weakref

import re
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pytest

from docmill.llm import _common, jaccard, packing, secrets, simhash, toxicity
from docmill.llm._common import BATCH_BYTES, BATCH_MAX, WordHashes, held, lean, small_batches

LONG = 700_000


@pytest.fixture
def unset(spark):
    spark.conf.unset(BATCH_BYTES)
    yield spark
    spark.conf.unset(BATCH_BYTES)


def largest_batch(spark):
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"rows": [len(b)], "chars": [int(b["text"].str.len().sum())]})

    texts = spark.range(40, numPartitions=1).selectExpr("id AS doc_id", f"repeat('ab cd ef ', {LONG} div 9) AS text")
    got = texts.mapInPandas(run, "rows long, chars long").toPandas()
    assert got["rows"].sum() == 40
    return got["chars"].max()


def documents(spark):
    return spark.createDataFrame([(i, f"words of text {i} and more") for i in range(8)], "doc_id long, text string")


@pytest.mark.parametrize("name", ["packing", "fingerprints", "jaccard", "secrets", "toxicity"])
def test_operators_bound_the_bytes_of_a_batch(unset, name):
    docs = documents(unset)
    if name == "packing":
        packing.pieces(docs)
    elif name == "fingerprints":
        simhash.fingerprints(docs)
    elif name == "jaccard":
        jaccard.near_duplicates(docs)
    elif name == "secrets":
        secrets.mask_secrets(docs)
    else:
        toxicity.with_scores(docs, unset.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert largest_batch(unset) <= BATCH_MAX + LONG


def test_a_limit_of_the_session_stays(unset):
    unset.conf.set(BATCH_BYTES, "1048576")
    small_batches(unset)
    assert unset.conf.get(BATCH_BYTES) == "1048576"


def test_a_worker_drops_the_encoder_when_it_turns_to_other_work():
    path = packing.public_tokenizer()
    made = weakref.ref(packing.encoder(path))
    assert made() is packing.encoder(path)
    hashes = held("words", WordHashes)
    gc.collect()
    assert made() is None and held("words", WordHashes) is hashes


def own_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_a_worker_gives_back_what_it_has_freed():
    pins = []

    def run(batches):
        for b in batches:
            made = [bytearray(60_000) for _ in range(2_000)]  # below the size that is mapped by itself
            pins.append(bytearray(60_000))  # above the others, so the heap's end does not move
            del made
            yield b

    before = own_mb()
    assert list(run(iter([1]))) == [1] and own_mb() - before > 60
    assert list(lean(run)(iter([1, 2]))) == [1, 2] and own_mb() - before < 30


def test_secrets_need_nothing_of_what_near_duplicates_remembered(spark, monkeypatch):
    made, freed = [], []
    docs = documents(spark)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: made.append(run) or self)
    monkeypatch.setattr(_common, "give_back", lambda: freed.append(1))
    secrets.mask_secrets(docs)
    held("words", WordHashes)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["token: abcdef1234", None]})
    assert [b.column(1).to_pylist() for b in made[0](iter([batch]))] == [["[SECRET]", None]]
    assert not _common.HELD and freed
