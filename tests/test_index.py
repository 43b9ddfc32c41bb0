"""The chunk index at page and thread grain, and versions that are switched as a whole."""

import os

import pytest

from docmill.operators.text import chunk_hierarchical, chunk_pages, thread_summaries
from docmill.plans.pipelines import build_chunk_index, merge_pages, newest_pages
from docmill.sources.versions import Versions

KIND = "thread_id string, document_id string, page_no int, title string, type string, text string"


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(map(str, (r[c] for c in cols))) for r in df.collect()))


def pages(spark, made):
    return spark.createDataFrame([(t, d, p, f"Title {d}", kind, x) for t, d, p, kind, x in made], KIND)


def test_documents_in_two_threads_keep_their_rows(spark):
    one = [("a", "d", 1, "text", "Some words here."), ("a", "d", 2, "text", "Other words there.")]
    alone = build_chunk_index(pages(spark, one))
    both = build_chunk_index(pages(spark, one + [("b", *x[1:]) for x in one] + [("b", "e", 1, None, "More.")]))
    for thread in "ab":
        assert rows(both.where(f"thread_id = '{thread}' AND document_id = 'd'").drop("thread_id")) == rows(alone.drop("thread_id"))
    assert both.where("document_id = 'e'").count() == 2


def test_blank_pages_and_missing_types(spark):
    made = [("a", "d", 1, None, " \n"), ("a", "d", 2, None, "Alpha was here."), ("a", "d", 3, None, "so Alpha left."), ("a", "s", 1, "spreadsheet", "Alpha"), ("a", "n", 1, "text", None)]
    out = build_chunk_index(pages(spark, made)).collect()
    assert sorted((r["chunk_type"], r["page_no"]) for r in out) == [("child", 2), ("child", 3), ("document_summary", 0), ("entity_profile", 0)]
    text = {r["chunk_type"]: r["text"] for r in out}
    assert "Alpha was here." in text["document_summary"] and "pages: 2, 3" in text["entity_profile"]
    assert all("/3\n" in r["text"] for r in out if r["chunk_type"] == "child")


def test_topics_are_the_most_frequent_words_of_the_document(spark):
    words = [f"word{chr(97 + i)}" for i in range(20)]
    made = [("a", "d", 1, None, " ".join(words)), ("a", "d", 2, None, "late " * 30 + "wordc")]
    out = build_chunk_index(pages(spark, made)).where("page_no = 1").first()["text"]
    assert "Topics: late, wordc, worda, wordb, wordd, worde, wordf, wordg\n" in out


def test_children_know_parents_and_names(spark):
    text = "\n".join(f"Line {i} tells of Person{chr(97 + i % 26)} and others at length." for i in range(120))
    out = build_chunk_index(pages(spark, [("a", "d", 4, None, text)])).where("chunk_type = 'child'").orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in out] == list(range(len(out))) and len({r["parent_idx"] for r in out}) > 3
    assert all(r["chunk_id"] == f"{r['parent_chunk_id']}_c{r['child_idx']}" and r["parent_chunk_id"] == f"d_page4_p{r['parent_idx']}" for r in out)
    assert all(0 < len(r["entities"]) <= 15 and all(n in r["text"] for n in r["entities"]) for r in out)


def test_udtf_equals_the_map(spark):
    texts = ["x" * 3000, "", None, "\n".join(f"Line {i} " + "word " * (i % 30) for i in range(300)), "a. b? c! " * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    cols = ["id", "parent_idx", "child_idx", "parent_text", "text"]
    out = chunk_pages(df, "text")
    assert rows(out.select(cols)) == rows(chunk_hierarchical(df, "id", "text").select(cols))
    flat = {(r["id"], r["chunk_index"]): r for r in out.collect()}
    for (i, k), r in flat.items():
        near = [flat.get((i, k + d)) for d in (-1, 1)]
        assert (r["before"], r["after"]) == tuple(x and x["text"] for x in near)


def test_of_two_versions_the_newest_counts(spark):
    df = spark.createDataFrame([("a", "d", 1, "zz", 1), ("a", "d", 1, "aa", 2), ("a", "d", 2, "b", 0), ("a", "d", 2, "b", 0)], "thread_id string, document_id string, page_no int, text string, at int")
    assert rows(newest_pages(df, "at").select("page_no", "text")) == [("1", "aa"), ("2", "b")]


class Crash(Exception):
    pass


def test_versions(spark, tmp_path, monkeypatch):
    base = f"{tmp_path}/index"
    store = Versions(spark, base)
    held = {}
    for v in range(5):
        made = [("a", f"d{k}", 1 + v % 3, None, f"Text of {k} in {v}.") for k in range(v % 4, 12, 4)] + [("b", "e", v + 1, None, f"page {v}")]
        batch = pages(spark, made)
        if v == 3:  # ends after the data is written, before it is published
            with monkeypatch.context() as m, pytest.raises(Crash):
                m.setattr(Versions, "switch", lambda *_: (_ for _ in ()).throw(Crash()))
                merge_pages(store, batch, v, parts=3)
            assert store.versions()[-1] == 2 and rows(store.read("pages").drop("part")) == before  # noqa: F821
        merge_pages(store, batch, v, parts=3)
        merge_pages(store, batch, v, parts=3)  # a replay
        held |= {x[:3]: x for x in made}
        before = rows(store.read("pages").drop("part"))
        assert before == rows(pages(spark, held.values()))
    assert rows(store.read("chunks").drop("part")) == rows(build_chunk_index(pages(spark, held.values())))
    assert store.versions() == [3, 4]
    for table in ("pages", "chunks"):
        parts = [p for v in os.listdir(f"{base}/{table}") for p in os.listdir(f"{base}/{table}/{v}") if p.startswith("part=")]
        assert parts and max(map(parts.count, parts)) <= 2
    with pytest.raises(OSError):
        store.switch(4, {})


def test_summaries_come_in_blocks(spark):
    made = [("t", i, f"T{i}", f"s{i}") for i in range(30)] + [("u", 1, "x", None), (None, 2, "n", "own")]
    out = thread_summaries(spark.createDataFrame(made, "thread string, i int, title string, summary string"), "thread", "i", "title", "summary", 50).collect()
    own = sorted((r["block"], r["summaries"]) for r in out if r["thread"] == "t")
    assert len(own) > 3 and "\n".join(s for _, s in own) == "\n".join(f"T{i}: s{i}" for i in range(30))
    assert [(r["block"], r["n_summaries"], r["summaries"]) for r in out if r["thread"] != "t"] in ([(0, 0, ""), (0, 1, "n: own")], [(0, 1, "n: own"), (0, 0, "")])
