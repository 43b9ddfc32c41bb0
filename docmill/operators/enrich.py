"""Keywords, headings, summaries, entities, triples and trees."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.scratch import scratch
from docmill.functions.words import SYNONYMS, ascii_words, ranked, stop_words, tokens

SENTENCE = r"(?<=[.!?])\s+"
#: A word of a text, and a word that can be part of a name. One class each, nothing repeated but
#: characters: patterns with a repeated group overflow the stack on long runs of capitals.
WORD = r"[\p{L}\p{N}_]+"
CAPITAL = r"^\p{Lu}\p{Ll}+$"
#: A name (group 1), a run of capitalised words with one space between them, or words up to the next capital or one word
#: that begins none. What is repeated is possessive, so nothing is tried twice and the stack doesn't grow with a run.
_CAPITAL = rf"\p{{Lu}}\p{{Ll}}++(?!{WORD[:-1]})"
NAME_OR_WORD = rf"({_CAPITAL}(?: {_CAPITAL})*+)|(?:(?!\p{{Lu}}){WORD}+[^\p{{L}}\p{{N}}_]*+)++|{WORD}+"
#: Characters that stand for the start and the end of a name in a marked text.
START, END = "\x01", "\x02"


def document_keywords(df: DataFrame, id_col: str, text_col: str, top_n: int = 8) -> DataFrame:
    """(id, rank, word, n): the most frequent words; ties by first appearance. A text's words are counted where
    it lies: each batch is coded once, and its distinct words alone are held against the stop words."""
    own = df.select(F.col(id_col).alias("_id"), tokens(text_col).alias("_words"))
    stops, word = frozenset(stop_words()), re.compile("[a-z]{3,}")

    def count(batches):
        for b in batches:
            words = b.column("_words")
            codes = words.flatten().dictionary_encode()
            known = codes.dictionary.to_pylist()
            good = np.fromiter((w not in stops and bool(word.fullmatch(w)) for w in known), bool, len(known))
            row = np.repeat(np.arange(b.num_rows, dtype=np.int64), pa.compute.list_value_length(words).to_numpy(zero_copy_only=False))
            code = codes.indices.to_numpy(zero_copy_only=False)
            row, code = row[good[code]], code[good[code]]
            key, first, n = np.unique(row * max(1, len(known)) + code, return_index=True, return_counts=True)
            row, code = np.divmod(key, max(1, len(known)))
            order = np.lexsort((first, -n, row))
            row, code, n = row[order], code[order], n[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            kept = rank <= top_n
            columns = [b.column("_id").take(pa.array(row[kept])), pa.array(rank[kept].astype(np.int32)), codes.dictionary.take(pa.array(code[kept])), pa.array(n[kept])]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "rank", "word", "n"])

    out = own.mapInArrow(count, f"_id {own.schema['_id'].dataType.simpleString()}, rank int, word string, n long")
    return out.withColumnRenamed("_id", id_col)


def heading_of(text):
    """The first eligible line of a text's first five decides; empty if it is no heading, null if there is none."""
    lines = F.transform(F.slice(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")), "\n"), 1, 5), lambda x: F.trim(x))

    def judged(line):
        capital = (F.upper(line) == line) & (F.lower(line) != line) & (F.length(line) > 3) & (F.length(line) < 80)
        return (
            F.when(line.rlike(r"(?i)^(\d+[.\)]\s|chapter\s+\d+|section\s+\d+)"), F.substring(line, 1, 100))
            .when(capital, line)
            .when((F.length(line) < 80) & ~line.rlike(r"[.,;:!?)\"']$"), line)
            .otherwise("")
        )

    eligible = F.filter(lines, lambda x: (F.length(x) >= 3) & (F.length(x) <= 120))
    return F.get(F.transform(F.slice(eligible, 1, 1), judged), F.lit(0))


def page_heading(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, heading): the first eligible line of the first five decides; empty if it is none."""
    return df.select(id_col, F.coalesce(heading_of(F.col(text_col)), F.lit("")).alias("heading"))


def lead_sentences(start, max_chars: int = 500):
    """The first sentences of a text that fit ``max_chars`` together, or its beginning."""
    sentences = F.filter(F.split(start, SENTENCE), lambda s: F.trim(s) != "")
    init = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def step(s, x):
        grown = F.when(s["text"] == "", x).otherwise(F.concat(s["text"], F.lit(" "), x))
        fits = s["open"] & (F.length(grown) <= max_chars)
        return F.struct(F.when(fits, grown).otherwise(s["text"]).alias("text"), fits.alias("open"))

    lead = F.aggregate(sentences, init, step, lambda s: s["text"])
    return F.when(lead == "", F.substring(start, 1, max_chars)).otherwise(lead)


def summary_chunk(df: DataFrame, id_col: str, text_col: str, summary_col: str | None = None, max_chars: int = 500, head: int = 3000) -> DataFrame:
    """(id, chunk_index, summary): the stored summary, else lead sentences within ``max_chars``."""
    lead = lead_sentences(F.substring(F.coalesce(text_col, F.lit("")), 1, head), max_chars)
    stored = F.col(summary_col) if summary_col else F.lit(None).cast("string")
    out = F.when(F.length(F.trim(F.coalesce(stored, F.lit("")))) > 0, stored).otherwise(lead)
    return df.select(id_col, F.lit(-1).alias("chunk_index"), out.alias("summary"))


def context_of(before, after, chars: int = 100):
    """The last sentence of the text ``before`` and the first one of ``after``, cut to ``chars``."""
    parts = lambda c: F.filter(F.split(c, SENTENCE), lambda s: F.trim(s) != "")
    last, first = F.try_element_at(parts(before), F.lit(-1)), F.get(parts(after), F.lit(0))
    return F.concat_ws(" | ", F.concat(F.lit("..."), F.substring(last, 1, chars)), F.concat(F.substring(first, 1, chars), F.lit("...")))


def adjacent_context(chunks: DataFrame, page_keys: list[str], order_col: str, text_col: str, chars: int = 100) -> DataFrame:
    """Chunks with ``context``: last sentence before and first sentence after, within the page."""
    w = Window.partitionBy(*page_keys).orderBy(order_col)
    return chunks.withColumn("context", context_of(F.lag(text_col).over(w), F.lead(text_col).over(w), chars))


def enriched_text(title, page_no, pages, section, keywords, context, text):
    """Header lines, a blank line and the chunk as one column; null or empty parts are left out."""
    part = lambda name, c: F.when(F.length(F.coalesce(c, F.lit(""))) > 0, F.concat(F.lit(f"{name}: "), c))
    page = F.concat(F.lit("Page: "), page_no.cast("string"), F.lit("/"), pages.cast("string"))
    header = F.concat_ws("\n", part("Document", title), page, part("Section", section), part("Topics", keywords), part("Context", context))
    return F.concat(header, F.lit("\n\n"), text)


def marked(text):
    """A text with START before and END after each name: a run of capitalised words with one space
    between them. The text is taken apart into its words and what lies between; a word begins a
    name, goes on with one or is none, so the work is in proportion to the text."""
    c = F.translate(F.coalesce(text, F.lit("")), START + END, "  ")
    words = F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    gaps = F.split(c, WORD, -1)
    row = F.struct(words.alias("w"), F.transform(words, lambda w: w.rlike(CAPITAL)).alias("cap"), gaps.alias("gap"))

    def pieces(r):
        def piece(w, i):
            cap, before, gap = F.get(r["cap"], i), F.coalesce(F.get(r["cap"], i - 1), F.lit(False)), F.get(r["gap"], i)
            on = cap & before & (gap == " ")
            return F.concat(F.when(before & ~on, END).otherwise(""), gap, F.when(cap & ~on, START).otherwise(""), w)

        end = F.when(F.coalesce(F.try_element_at(r["cap"], F.lit(-1)), F.lit(False)), END).otherwise("")
        return F.concat(F.array_join(F.transform(r["w"], piece), ""), end, F.coalesce(F.try_element_at(r["gap"], F.lit(-1)), F.lit("")))

    # the arrays are made once, in an array of one, and not once for each use
    return F.get(F.transform(F.array(row), pieces), F.lit(0))


def entity_names(text):
    """The default entity extractor: capitalised phrases of a text column, in order. Any function of
    a column to array<string>, a pandas UDF over a model say, can take its place."""
    return F.array_remove(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NAME_OR_WORD), F.lit(1)), F.lit(""))


def entity_mentions(df: DataFrame, id_col: str, text_col: str, head: int = 5000, most: int = 15, extractor=entity_names) -> DataFrame:
    """(id, rank, name): names, without regard to case once, in first-seen order."""
    each = df.select(id_col, F.posexplode(extractor(F.substring(text_col, 1, head))).alias("pos", "name")).withColumn("key", F.lower("name"))
    each = each.where((F.length("name") >= 2) & ~F.col("key").isin(*stop_words()))
    first = each.groupBy(id_col, "key").agg(F.min(F.struct("pos", "name")).alias("m"))
    out = first.select(id_col, F.col("m.name").alias("name"), ranked([id_col], F.col("m.pos")).alias("rank"))
    return out.where(F.col("rank") <= most).select(id_col, "rank", "name")


def clean_names(names):
    """Names of two or more characters that are no stop words, without regard to case once, in order."""
    def kept(row):
        good = lambda x, i: (F.length(x) >= 2) & ~F.get(row["low"], i).isin(*stop_words()) & (F.array_position(row["low"], F.get(row["low"], i)) == i + 1)
        return F.filter(row["names"], good)

    return F.get(F.transform(F.array(F.struct(names.alias("names"), F.transform(names, F.lower).alias("low"))), kept), F.lit(0))


def chunk_mentions(chunks: DataFrame, text_col: str, extractor=entity_names) -> DataFrame:
    """``chunks`` with a row for each ``name`` that a chunk's whole text mentions, without regard to case once."""
    return chunks.withColumn("_names", extractor(F.col(text_col))).select(*chunks.columns, F.explode(clean_names(F.col("_names"))).alias("name"))


def entity_profiles(
    mentions: DataFrame, doc_col: str | list[str], page_col: str, name_col: str, text_col: str, max_profiles: int = 10, around: int = 60, chunk_col: str | None = None
) -> DataFrame:
    """(doc, name, n_pages, pages, contexts): the ten entities on most pages, then those on two or
    more; ties by first appearance. A context is what stands around a name where it first occurs in
    a chunk, whatever its case. ``chunk_col`` orders the chunks of a page where each mention has its
    chunk's text; ``doc_col`` may be several columns."""
    docs = [doc_col] if isinstance(doc_col, str) else doc_col
    key = mentions.withColumn("_key", F.lower(name_col)).withColumn("_at", F.expr(f"locate(lower({name_col}), lower({text_col}))"))
    cut = F.expr(f"trim(substring({text_col}, greatest(1, _at - {around}), length({name_col}) + {around} + least({around}, _at - 1)))")
    key = key.withColumn("_context", cut)
    order = [page_col, *([chunk_col] if chunk_col else []), "_at"]
    # one row a page first, so a name on every page of a long document is gathered by its pages
    page = key.groupBy(*docs, "_key", page_col).agg(F.min(F.struct(*[c for c in order if c != page_col], F.col(name_col).alias("_name"))).alias("_m"))
    spread = page.groupBy(*docs, "_key").agg(F.count(F.lit(1)).alias("n_pages"), F.min(F.struct(page_col, "_m")).alias("_first"))
    top = spread.withColumn("_r", ranked(docs, F.desc("n_pages"), F.asc("_first"), F.asc("_key"))).where(F.col("_r") <= max_profiles).where("n_pages >= 2")
    top = top.select(*docs, "_key", "n_pages", F.col("_first._m._name").alias("name"))
    on = page.join(top.select(*docs, "_key"), [*docs, "_key"], "left_semi").groupBy(*docs, "_key").agg(F.array_sort(F.collect_set(page_col)).alias("pages"))
    some = key.join(top.select(*docs, "_key"), [*docs, "_key"], "left_semi").withColumn("_r", ranked([*docs, "_key"], *map(F.col, order))).where("_r <= 3")
    some = some.groupBy(*docs, "_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_context"))), lambda x: x["_context"]).alias("contexts"))
    return top.join(on, [*docs, "_key"]).join(some, [*docs, "_key"]).select(*docs, "name", "n_pages", "pages", "contexts")


def expand_query_terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term): query words and their synonyms, once each."""
    spark = df.sparkSession
    table = spark.createDataFrame([(k, s) for k, v in SYNONYMS.items() for s in v], "term string, synonym string")
    word = df.select(id_col, F.explode(F.array_distinct(ascii_words(text_col))).alias("term"))
    return word.union(word.join(F.broadcast(table), "term").select(id_col, "synonym")).distinct()


def entity_triples(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sentence, subject, predicate, object): each entity with its next two in the sentence."""
    s = df.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), SENTENCE)).alias("sentence", "s")).where(F.length("s") >= 10)
    # every part but the first is a name, END and what follows up to the next name
    s = s.withColumn("parts", F.split(marked(F.col("s")), START)).where(F.size("parts") >= 3)
    part = F.transform(F.slice("parts", 2, F.size("parts") - 1), lambda x: F.struct(F.substring_index(x, END, 1).alias("name"), F.substring_index(x, END, -1).alias("after")))
    s = s.select(id_col, "sentence", part.alias("p"))
    pair = F.expr(
        "filter(flatten(transform(p, (x, i) -> array("
        "named_struct('i', i, 'k', 1, 'subject', x.name, 'predicate', x.after, 'object', get(p, i + 1).name),"
        "named_struct('i', i, 'k', 2, 'subject', x.name, 'predicate', concat(x.after, get(p, i + 1).name, get(p, i + 1).after), 'object', get(p, i + 2).name)"
        "))), x -> x.object is not null)"
    )
    t = s.select(id_col, "sentence", F.explode(pair).alias("t")).select(id_col, "sentence", "t.i", "t.k", "t.subject", F.regexp_replace("t.predicate", r"^[ ,;:]+|[ ,;:]+$", "").alias("predicate"), "t.object")
    return t.where((F.length("predicate") >= 2) & (F.length("predicate") <= 80) & F.col("predicate").rlike(r"\p{L}"))


def store_triples(stored: DataFrame, new: DataFrame, order: list[str], doc_col: str = "document_id") -> DataFrame:
    """Rows of ``new`` that are first of their (document, subject, predicate, object) and not stored."""
    key = [doc_col, "subject", "predicate", "object"]
    return new.withColumn("_r", ranked(key, *map(F.col, order))).where("_r = 1").drop("_r").join(stored.select(*key), key, "left_anti")


def name_grams(triples: DataFrame, sizes: tuple[int, ...] = (3,)) -> DataFrame:
    """(gram, name): postings of all runs of ``sizes`` characters in the distinct subjects and objects, in lower case."""
    name = triples.select(F.explode(F.array(F.lower("subject"), F.lower("object"))).alias("name")).where("name is not null").distinct()
    grams = F.flatten(F.array(*[
        F.when(F.length("name") >= n, F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substring(F.col("name"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))  # noqa: B023
        for n in sizes
    ]))
    return name.select(F.explode(F.array_distinct(grams)).alias("gram"), "name")


def names_with(grams: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, name): the names of ``grams`` that contain each of the distinct lower-case ``entities`` (entity).
    The postings of an entity's two rarest runs of three characters are intersected, what is left is
    verified. An entity of one or two characters is a run of its own; ``grams`` must hold those sizes."""
    n = F.least(F.length("entity"), F.lit(3))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("entity") - n + 1), lambda i: F.substring(F.col("entity"), i, n)))
    asked = entities.where("length(entity) > 0").select("entity", F.explode(runs).alias("gram"))
    held = grams.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = asked.join(held, "gram", "left").withColumn("r", ranked(["entity"], F.coalesce("n", F.lit(0)), F.col("gram")))
    few = asked.where(F.col("r") <= 2).withColumn("asks", F.count(F.lit(1)).over(Window.partitionBy("entity")))
    met = grams.join(few.select("entity", "gram", "asks"), "gram").groupBy("entity", "name").agg(F.count(F.lit(1)).alias("k"), F.max("asks").alias("asks"))
    return met.where((F.col("k") == F.col("asks")) & F.contains(F.col("name"), F.col("entity"))).select("entity", "name")


def triples_for_entities(triples: DataFrame, asked: DataFrame, order: list[str], per_entity: int = 20, overall: int = 20, grams: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, subject, predicate, object) whose subject or object contains an asked entity, whatever
    the case. ``asked`` is (query_id, pos, entity); an empty entity asks for nothing. ``grams`` are the stored
    ``name_grams`` of the triples, of the sizes 1 to 3 if short entities are asked for."""
    asked = asked.withColumn("_entity", F.lower("entity"))
    entities = asked.select(F.col("_entity").alias("entity")).where("length(entity) > 0").distinct()
    if grams is None:
        short = not entities.where("length(entity) < 3").isEmpty()
        grams = name_grams(triples, (1, 2, 3) if short else (3,))
    found = names_with(grams, entities).groupBy("name").agg(F.collect_set("entity").alias("es"))  # of one name's parts
    side = lambda c: found.select(F.col("name").alias(f"_{c}_name"), F.col("es").alias(f"_{c}_es"))
    hit = triples
    for c in ("subject", "object"):
        hit = hit.join(side(c), F.lower(c) == F.col(f"_{c}_name"), "left").drop(f"_{c}_name")
    none = F.array().cast("array<string>")
    each = F.explode(F.array_union(F.coalesce("_subject_es", none), F.coalesce("_object_es", none)))
    hit = hit.withColumn("_entity", each).drop("_subject_es", "_object_es")
    # an entity's first triples are the same for whoever asks for it
    hit = hit.withColumn("_r", ranked(["_entity"], *map(F.col, order))).where(F.col("_r") <= per_entity).join(asked, "_entity")
    low = [F.lower(c).alias(f"_{c}") for c in ("subject", "predicate", "object")]
    hit = hit.select("*", *low).withColumn("_d", ranked(["query_id", "_subject", "_predicate", "_object"], F.col("pos"), F.col("_r"))).where("_d = 1")
    out = hit.withColumn("rank", ranked(["query_id"], F.col("pos"), F.col("_r"))).where(F.col("rank") <= overall)
    return out.select("query_id", "rank", "subject", "predicate", "object")


def triple_context(hits: DataFrame) -> DataFrame:
    """(query_id, context): one line a triple under a heading."""
    line = F.concat_ws(" ", F.lit("-"), "subject", "predicate", "object")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"])
    return hits.groupBy("query_id").agg(F.concat(F.lit("Entity Relationships:\n"), F.array_join(lines, "\n")).alias("context"))


def node_tree(spark: SparkSession, nodes: DataFrame, save=None) -> DataFrame:
    """(id, depth, path, root, n_children) of the nodes that a root reaches. Pointers double: each
    round every node jumps to what its ancestor so far points at, so a tree of depth n takes log n
    joins. ``save`` writes the table of a round and reads it back (by default as a checkpoint)."""
    edges = nodes.select("id", F.when(F.length(F.coalesce("parent_id", F.lit(""))) > 0, F.col("parent_id")).alias("up"))
    known = edges.select(F.col("id").alias("up")).distinct()
    lost = edges.where("up is not null").join(known, "up", "left_anti").select("id").withColumn("lost", F.lit(True))
    # up: the next ancestor to ask, null at a root; path: from below up to the node itself
    state = edges.join(lost, "id", "left").select("id", "up", F.array("id").alias("path"), F.coalesce("lost", F.lit(False)).alias("lost"))
    save = save or (lambda df: df.checkpoint())
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch(spark, "trees"))
    state = save(state)
    while not state.where("up is not null and not lost").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("lost").alias("_lost"))
        # a node that is its own ancestor lies on a cycle
        gone = F.col("lost") | F.coalesce("_lost", F.lit(False)) | F.coalesce(F.array_contains("_path", F.col("id")), F.lit(False))
        jumped = state.join(above, "up", "left").select("id", "path", "_up", "_path", gone.alias("lost"))
        path = F.when(F.col("lost") | F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path"))
        state = save(jumped.select("id", F.when(~F.col("lost"), F.col("_up")).alias("up"), path.alias("path"), "lost"))
    tree = state.where("not lost")
    children = edges.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = tree.select("id", (F.size("path") - 1).alias("depth"), F.array_join("path", "/").alias("path"), F.col("path")[0].alias("root"))
    return tree.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
