"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest

from docmill.llm import lmscore, linefreq, mixing, packing, pagetext, secrets, sharding, simhash, toxicity, vectors

LONG = "word filler text " * 40_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, size int, piece string, fp string, row int, host string"
ROWS = [
    (1, "alpha beta gamma delta", "en", "s", 22, None, 1, "x", "y", 0, "h"),
    (1, "alpha beta gamma delta", "en", "s", 22, None, 1, "x", "y", 0, "h"),
    (2, None, None, None, None, None, None, None, None, None, None),
    (3, "", "en", "s", 0, 1, 1, "", "", 1, ""),
    (4, " \t\n ", "en", "t", 4, 1, 1, "", "", 1, ""),
    (5, LONG, "en", "t", len(LONG), 1, 1, "", "", 1, ""),
    (None, "no id at all token=abcdef123", "en", "t", 27, 1, 1, "", "", 1, ""),
    (6, "éà 日本語   x\x00y", "en", "t", 12, 1, 1, "", "", 1, ""),
]


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def want(docs):
    return sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str)


def test_row_operators_return_every_row(spark, docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    for out in (
        simhash.near_duplicates(docs),
        linefreq.line_quality(docs),
        secrets.find_secrets(docs),
        sharding.shard_documents(docs),
        lmscore.score_documents(docs, docs),
        lmscore.score_documents(docs, docs.limit(0)),
        toxicity.score_toxicity(docs, labels),
        toxicity.score_toxicity(docs, labels.limit(0)),
        mixing.token_counts(docs),
    ):
        assert ids(out) == want(docs), out.columns


def test_packing_keeps_every_piece(docs):
    out = packing.pack_documents(docs).where("piece = 0")
    assert ids(out) == want(docs)


def test_mixing_draws_only_rows_with_tokens(docs):
    drawn = {r["doc_id"] for r in mixing.mix(docs).collect()}
    assert drawn <= {1, 5, 6, None}
    assert set(mixing.mixed_rows(docs).columns) == set(docs.columns)
    assert mixing.mixed_rows(docs).count() == mixing.mix(docs).count()


def test_masking_keeps_rows_and_columns(docs):
    out = secrets.mask_secrets(docs)
    assert out.schema == docs.schema and ids(out) == want(docs)
    assert not [r for r in out.collect() if "abcdef123" in (r["text"] or "")]


def test_pages(spark):
    rows = [(1, None, None, 0), (1, "http://a/x", "", 0), (None, "::", "<p>a<p>b &amp; c", 1), (2, "http://a/x", "<p>" * 3000 + "x", 1)]
    schema = "page_id long, url string, html string, row int"
    out = pagetext.page_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r["text"] for r in out) == ["", "", "a\nb & c", "x"]
    assert pagetext.page_text(spark.createDataFrame([], schema)).count() == 0


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, row string"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1, ""), (1, [1.0, 0.0], 1, ""), (2, [2.0, 0.01], 1, ""), (3, [0.0, 0.0], 1, ""), (4, None, 1, ""), (5, [], 1, "")]
    rows += [(6, [1.0, None], 1, ""), (7, [nan, 1.0], 1, ""), (8, [inf, 1.0], 1, ""), (9, [1.0, 0.0], None, ""), (10, [1.0, 0.0], 2, ""), (11, [1.0, 0.0, 0.0], 1, ""), (None, [0.0, 1.0], 1, "")]
    out = vectors.link_vectors(spark.createDataFrame(rows, schema)).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), *[(i, 0, i) for i in range(3, 12)], (None, 0, None)], key=str)
    assert vectors.link_vectors(spark.createDataFrame([], schema)).count() == 0
