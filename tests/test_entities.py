"""Entity profiles come from whole texts, chunk by chunk, without a cap on names."""

import re

from pyspark.sql import functions as F

from docmill.functions.words import stop_words
from docmill.operators import enrich
from docmill.operators.text import split_recursive
from docmill.plans.pipelines import build_chunk_index

NAME = re.compile(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)\b")
LATIN = "alpha bravo corin delphi ektor fenwick gorlam hestia ivarsen jorvik kelmar lundby mordal nestor orwin pelham quorra".split()


def page(no):
    body = [f"Then {n.title()} spoke of page {no} and went away." for n in LATIN] + ["it was a long and quiet day in town."] * 150
    return " ".join([*body, "At last Zephyra came by."])


def test_profiles_against_brute_force(spark):
    texts = {1: page(1), 2: page(2), 3: "only Zephyra was here"}
    known = {}
    for no, text in texts.items():
        for parent in split_recursive(text, 1500, 150):
            for small in split_recursive(parent, 500, 75):
                for name in dict.fromkeys(NAME.findall(small)):
                    if len(name) >= 2 and name.lower() not in set(stop_words()):
                        pages, contexts = known.setdefault(name, (set(), []))
                        pages.add(no)
                        if len(contexts) < 3:
                            contexts.append(small[max(0, small.find(name) - 60) :])
    best = sorted(known, key=lambda n: -len(known[n][0]))[:10]  # ties by first appearance
    rows = [("d", "t", no, "Title", x) for no, x in texts.items()]
    pages = spark.createDataFrame(rows, "document_id string, thread_id string, page_no int, title string, text string")
    out = build_chunk_index(pages).where("chunk_type = 'entity_profile'").collect()
    got = {r["entities"][0]: r["text"] for r in out}
    assert set(got) == set(best)
    assert all(f"Mentioned on pages: {', '.join(map(str, sorted(known[n][0])))}\n" in got[n] for n in got)
    assert all(got[n].count(" ... ") == len(known[n][1]) - 1 for n in got)


def test_chunk_mentions_have_no_cap(spark):
    text = " and ".join(f"Name{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600))
    rows = spark.createDataFrame([(1, text + " and Nameaa"), (2, None)], "id int, text string")
    out = enrich.chunk_mentions(rows, "text").groupBy("id").agg(F.count(F.lit(1)), F.countDistinct("name")).collect()
    assert [tuple(r) for r in out] == [(1, 600, 600)]


def test_runs_of_capitals_of_any_length(spark):
    n = 1_000_000
    texts = {1: " ".join(["Alpha"] * n), 2: ", ".join(f"Name{chr(97 + i % 26)}" for i in range(n)), 3: None, 4: "", 5: "A Bc Dé Éa  Xa Xb\nYa, x Za9 Ab-Cd \x01Q\x02r Öl"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string").repartition(5)
    names = {r["id"]: r["n"] for r in df.select("id", enrich.entity_names(F.col("text")).alias("n")).collect()}
    assert names[1] == [texts[1]] and names[2] == texts[2].split(", ") and names[3] == names[4] == []
    assert names[5] == ["Bc Dé Éa", "Xa Xb", "Ya", "Ab", "Cd", "Öl"]
    assert enrich.entity_mentions(df, "id", "text", head=2**31 - 1, most=2**31 - 1).where("id = 2").count() == 26


def test_triples_of_a_sentence(spark):
    df = spark.createDataFrame([(1, "Alpha met Beta Gamma, who saw Delta. Alpha; Beta -- too short? No Ending Here"), (2, None)], "id int, text string")
    out = sorted((r["i"], r["k"], r["subject"], r["predicate"], r["object"]) for r in enrich.entity_triples(df, "id", "text").where("sentence = 0").collect())
    assert out == [(0, 1, "Alpha", "met", "Beta Gamma"), (0, 2, "Alpha", "met Beta Gamma, who saw", "Delta"), (1, 1, "Beta Gamma", "who saw", "Delta")]
