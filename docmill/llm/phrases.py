"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores a posting (term, text key, position) for every word of every text, sorted by
term in each shard of texts. A shard is what one task read, so the index needs no shuffle however
often a term occurs. ``phrase_matches`` takes the windows of the test items, counts each test
term's postings, and intersects the offset-adjusted lists of the two rarest terms of a window;
what is left is looked up at every other place of the window. ``proximity_matches`` finds the
rarest terms of an item near each other in any order. Only DataFrame operations run here.

Texts are told apart by two 64-bit hashes (``k1``, ``k2``), so copies of a text share their
matches and rows need no ids. Null and empty texts and items have no words: they match nothing.
An item without an id is named ''. Items with equal ids count once, equal rows each get a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm._common import Scratch, cut, free_name, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words, capitals being parts of words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows up to which a table of test terms or probes is broadcast; beyond it Spark shuffles.
SMALL = 1_000_000
KEY = ["k1", "k2"]


def words(text: Column) -> Column:
    """The words of a text as they stand: runs of digits, letters and anything beyond ASCII."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def lowered(c: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` is faster but would change other letters too."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_key(text: Column) -> list[Column]:
    c = F.coalesce(text, F.lit(""))
    return [F.xxhash64(c).alias("k1"), F.xxhash64(F.lit(1), c).alias("k2")]


def build_index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Postings (term, k1, k2, pos) of whole texts; to be written by the caller."""
    text = F.col(f"`{text_col}`")
    own = docs.select(*text_key(text), words(text).alias("w"))  # a step of its own: else each word hashes its text again
    return own.select(*KEY, F.posexplode("w").alias("pos", "word")).select(lowered(F.col("word")).alias("term"), *KEY, "pos").sortWithinPartitions("term")


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` to be broadcast where its rows are counted to be few; else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def windows(items: DataFrame, id_col: str, text_col: str, size: int, scratch) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (p, terms, span) of all items, and the items of each (p, item)."""
    w = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), words(lowered(F.col(f"`{text_col}`"))).alias("w")).where(F.size("w") > 0)
    span = F.least(F.size("w"), F.lit(size))
    each = w.select("item", "w", span.alias("span"), F.explode(F.sequence(F.lit(0), F.size("w") - span)).alias("start"))
    each = each.select("item", F.slice("w", F.col("start") + 1, F.col("span")).alias("terms"))
    known = scratch.cut(each.select("terms").distinct().withColumn("p", F.monotonically_increasing_id()).withColumn("span", F.size("terms")), "windows")
    return known, scratch.cut(each.join(known, "terms").select("p", "item").distinct(), "owners")


def ranked_places(index: DataFrame, known: DataFrame, scratch) -> DataFrame:
    """(p, span, at, term, r): each place of a window, the place of its rarest term first. Windows
    with a term that no text holds are left out."""
    place = known.select("p", "span", F.posexplode("terms").alias("at", "term"))
    counts = index.join(small(place.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    place = place.join(small(scratch.cut(counts, "counts")), "term")
    w = Window.partitionBy("p")
    place = place.withColumn("r", F.row_number().over(w.orderBy("n", "at"))).withColumn("held", F.count(F.lit(1)).over(w))
    return scratch.cut(place.where("held = span").select("p", "span", "at", "term", "r"), "places")


def phrase_matches(index: DataFrame, known: DataFrame, scratch, most: int = SMALL) -> DataFrame:
    """(k1, k2, p, start, span): every place at which a text holds a window (p, terms, span)."""
    place = ranked_places(index, known, scratch)
    # the offset-adjusted lists of the two rarest places, met at the window's start
    first = small(place.where("r <= 2"), most)
    lists = index.join(first, "term").select(*KEY, "p", "span", (F.col("pos") - F.col("at")).alias("start"), "r").where("start >= 0")
    met = lists.groupBy(*KEY, "p", "span", "start").agg(F.min("r").alias("low"), F.max("r").alias("high"))
    met = scratch.cut(met.where("low = 1 and high = least(2, span)").drop("low", "high"), "met")
    # what is left is looked up at the other places, each of them once whatever windows share it
    rest = met.join(small(place.where("r > 2").drop("span"), most), "p").select(*KEY, "p", "start", "span", (F.col("start") + F.col("at")).alias("pos"), "term")
    probes = scratch.cut(rest.select(*KEY, "pos", "term").distinct(), "probes")
    asked = small(probes, most)
    own = index if asked is not probes else index.join(small(place.select("term").distinct(), most), "term", "left_semi")
    found = scratch.cut(own.join(asked, [*KEY, "pos", "term"], "left_semi").distinct(), "found")
    whole = rest.join(small(found, most), [*KEY, "pos", "term"]).groupBy(*KEY, "p", "start", "span").agg(F.count(F.lit(1)).alias("n"))
    return whole.where("n = span - 2").drop("n").unionByName(met.where("span <= 2").select(*KEY, "p", "start", "span"))


def proximity_matches(index: DataFrame, items: DataFrame, id_col: str, text_col: str, scratch, rarest: int = 3, within: int = 20) -> DataFrame:
    """(k1, k2, item, start, end): the stretches of at most ``within`` words that hold the
    ``rarest`` rarest terms of an item in any order, each ending at one of these terms and beginning
    as late as can be. Items with fewer terms are found by all they have."""
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    term = items.select(name.alias("item"), F.explode(F.array_distinct(words(lowered(F.col(f"`{text_col}`"))))).alias("term")).distinct()
    counts = index.join(small(term.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    term = term.join(scratch.cut(counts, "near-counts"), "term", "left")
    term = term.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("n", F.lit(0)), "term"))).where(F.col("r") <= rarest)
    term = scratch.cut(term.withColumn("asked", F.count(F.lit(1)).over(Window.partitionBy("item"))), "near-terms")
    near = index.join(small(term.drop("n")), "term").select(*KEY, "item", "pos", "r", "asked").distinct()
    w = Window.partitionBy(*KEY, "item").orderBy("pos", "r").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("r") == k + 1, F.col("pos")), ignorenulls=True).over(w) for k in range(rarest)]
    near = near.withColumns({f"last{k}": c for k, c in enumerate(last)})
    lasts = [F.col(f"last{k}") for k in range(rarest)]
    n = sum((c.isNotNull().cast("int") for c in lasts[1:]), lasts[0].isNotNull().cast("int"))
    start = F.least(*lasts) if rarest > 1 else lasts[0]
    return near.where((n == F.col("asked")) & (F.col("pos") - start < within)).select(*KEY, "item", start.alias("start"), F.col("pos").alias("end")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside an occurrence of a window of ``size`` item words),
    items (sorted names of the items found) and contaminated, under these names or longer ones
    where ``docs`` has them."""
    scratch = Scratch(docs.sparkSession)
    index = scratch.cut(build_index(docs, text_col), "postings")
    known, owners = windows(items, id_col, "text", size, scratch)
    match = scratch.cut(phrase_matches(index, known, scratch), "matches")
    hit = match.select(*KEY, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("span") - 1)).alias("pos")).distinct()
    hit = hit.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_hit"))
    own = match.select(*KEY, "p").distinct().join(small(owners), "p").select(*KEY, "item").distinct()
    own = own.groupBy(*KEY).agg(F.array_sort(F.collect_list("item")).alias("_items"))
    verdict = cut(hit.join(own, KEY).withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), "verdict")
    scratch.clear()
    text = F.col(f"`{text_col}`")
    k1, k2 = text_key(text)
    names = [free_name(docs, n) for n in ("n_words", "n_hit", "items", "contaminated")]
    keyed = docs.select("*", F.size(words(text)).cast("long").alias(names[0]), k1.alias(a := free_name(docs, "_a")), k2.alias(b := free_name(docs, "_b")))
    both = keyed.join(verdict, (F.col(a) == F.col("_k1")) & (F.col(b) == F.col("_k2")), "left")
    return both.select(
        *[F.col(f"`{c}`") for c in docs.columns], names[0], F.coalesce("_hit", F.lit(0)).cast("long").alias(names[1]),
        F.coalesce("_items", F.array().cast("array<string>")).alias(names[2]), F.col("_hit").isNotNull().alias(names[3]),
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
