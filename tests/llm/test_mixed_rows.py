"""Each draw of the mixture gives one row."""

from collections import Counter

from docmill.llm import mixing


def test_rows_without_id_and_equal_rows(spark):
    rows = [(None, f"no id {'word ' * 20}{i}", "a", i) for i in range(5)] + [(7, "same text " * 10, "a", i) for i in range(4)]
    rows += [(100 + i, f"other {i} " * 10, "b", i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    for budget in (150, 290, 900):
        drawn = mixing.mix(docs, budget=budget, max_repeats=None).collect()
        out = mixing.mixed_rows(docs, budget=budget, max_repeats=None).collect()
        assert len(out) == len(drawn)
        assert Counter(r["source"] for r in out) == Counter(r["source"] for r in drawn)
        assert Counter(r["doc_id"] for r in out)[None] == sum(r["doc_id"] is None for r in drawn)
    times = Counter((r["doc_id"], r["n"]) for r in out if r["doc_id"] in (None, 7))
    assert len(times) == 9 and max(times.values()) - min(times.values()) <= 1
