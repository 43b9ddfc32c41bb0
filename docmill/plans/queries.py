"""Registered queries of the library's operators and the SQL they are checked with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.words import stop_words
from docmill.operators import cells, chat, enrich, lexical, retrieve, sheets, tables, text
from docmill.sources import readers
from docmill.streaming import status

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


SENTENCES = r"list_filter(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '')"
STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words())
SYNONYM_ROWS = ", ".join(f"('{k}', '{s}')" for k, v in enrich.SYNONYMS.items() for s in v)
TOKENS = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"
WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '\s+'), lambda w: w <> '')"
ASCII = "list_filter(" + TOKENS + r", lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN (" + STOPS + "))"


def names_sql(src: str, keys: str, text_: str = "text", out: str = "names") -> str:
    """CTEs that end with ``out`` (keys, i0, i1, name): runs of capitalised words with single spaces, by gaps and islands."""
    word = r"[\p{L}\p{N}_]+"
    return f"""{out}_w AS (SELECT {keys}, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, unnest(gs[1:len(ws)]) AS gap FROM
 (SELECT {keys}, regexp_extract_all({text_}, '{word}') AS ws, string_split_regex({text_}, '{word}') AS gs FROM {src}) WHERE len(ws) > 0),
{out}_c AS (SELECT *, regexp_full_match(w, '\\p{{Lu}}\\p{{Ll}}+') AS cap FROM {out}_w),
{out}_g AS (SELECT *, CASE WHEN cap AND gap = ' ' AND coalesce(lag(cap) OVER (PARTITION BY {keys} ORDER BY i), false) THEN 0 ELSE 1 END AS begins FROM {out}_c),
{out}_i AS (SELECT *, sum(begins) OVER (PARTITION BY {keys} ORDER BY i) AS island FROM {out}_g),
{out} AS (SELECT {keys}, min(i) AS i0, max(i) AS i1, string_agg(w, ' ' ORDER BY i) AS name FROM {out}_i WHERE cap GROUP BY {keys}, island)"""


HITS = rf"""
tok AS (SELECT source AS thread, doc_id AS chunk_id, unnest({TOKENS.format("text")}) AS term FROM documents),
tf AS (SELECT thread, chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
sizes AS (SELECT thread, chunk_id, sum(tf) AS dl FROM tf GROUP BY ALL),
nn AS (SELECT source AS thread, count(*) AS n FROM documents GROUP BY ALL),
av AS (SELECT thread, sum(dl)::DOUBLE / any_value(n) AS avgdl FROM sizes JOIN nn USING (thread) GROUP BY thread),
idf0 AS (SELECT thread, term, ln(any_value(n) - count(*) + cast(0.5 AS DOUBLE)) - ln(count(*) + cast(0.5 AS DOUBLE)) AS idf FROM tf JOIN nn USING (thread) GROUP BY thread, term),
me AS (SELECT thread, sum(cast(idf AS DECIMAL(38,10)))::DOUBLE / count(*) AS mean FROM idf0 GROUP BY thread),
idf AS (SELECT thread, term, CASE WHEN idf < 0 THEN cast(0.25 AS DOUBLE) * mean ELSE idf END AS idf FROM idf0 JOIN me USING (thread)),
post AS (SELECT thread, term, chunk_id, idf * tf * cast(2.5 AS DOUBLE) / (tf + cast(1.5 AS DOUBLE) * (cast(0.25 AS DOUBLE) + cast(0.75 AS DOUBLE) * dl / avgdl)) AS w
  FROM tf JOIN sizes USING (thread, chunk_id) JOIN av USING (thread) JOIN idf USING (thread, term)),
qt AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, thread, chunk_id, round(sum(cast(w * times AS DECIMAL(28,10)))::DOUBLE, 6) AS score FROM post JOIN qt USING (term) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id, thread ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 5),
hits AS (SELECT query_id, thread AS document_id, chunk_id, chunk_id % 10 AS page_no, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score,
   row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM top WHERE score > 0)"""


_STORES: dict = {}


def stored_index(spark, d):
    """The stored index of the documents of a folder, sources as threads; built once an application."""
    from docmill.sources.versions import Versions

    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        store = Versions(spark, readers.scratch(spark, "bm25"))
        lexical.write_index(store, t(spark, d, "documents"), "source", "doc_id", "text", max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        _STORES[key] = store.base
        spark.sparkContext._jvm.System.gc()  # else the shuffle files of the writing stay while the index is asked
    return Versions(spark, _STORES[key])


def bm25(spark, d, top_k=5):
    asked = t(spark, d, "benchmark")
    postings = lexical.postings(stored_index(spark, d), retrieve.query_terms(asked, "text"))
    return retrieve.bm25_topk(postings, asked, "item_id", "text", top_k)


def hits(spark, d):
    h = bm25(spark, d)
    q = Window.partitionBy("query_id")
    return h.select(
        "query_id", F.col("thread").alias("document_id"), "chunk_id", (F.col("chunk_id") % 10).alias("page_no"),
        F.round(F.col("score") / F.max("score").over(q), 6).alias("score"),
        (F.row_number().over(q.orderBy(F.desc("score"), "chunk_id")) - 1).alias("rank"),
    )


@query("SELECT p_brand, p_name, p_size FROM part WHERE p_name ILIKE '%a%' AND p_size > 10")
def sql_filter_like(spark, d):
    t(spark, d, "part").createOrReplaceTempView("part")
    return tables.guarded_select(spark, 'SELECT p_brand, p_name, p_size FROM "part" WHERE p_name ILIKE \'%a%\' AND p_size > 10', None)[0]


@query(
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc,"
    " min(l_tax) AS low, max(l_tax) AS high FROM lineitem GROUP BY ALL"
)
def sql_aggregate(spark, d):
    t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    q = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_tax) AS low, max(l_tax) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus"
    return tables.guarded_select(spark, q, None)[0]


@query(
    "SELECT n_name, count(*) AS n, round(sum(cast(o_totalprice AS DECIMAL(28,10)))::DOUBLE, 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey"
    " JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
)
def sql_join(spark, d):
    for name in ("orders", "customer", "nation"):
        t(spark, d, name).createOrReplaceTempView(name)
    q = "SELECT n_name, count(*) AS n, round(cast(sum(cast(o_totalprice AS DECIMAL(28,10))) AS DOUBLE), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
    return tables.guarded_select(spark, q, None)[0]


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def sql_topk(spark, d):
    t(spark, d, "orders").createOrReplaceTempView("orders")
    return tables.guarded_select(spark, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50", None)[0]


@query(
    "SELECT doc_id, lang, source, n_chars, trim(regexp_replace(regexp_replace(text, '[ ​‌‍﻿]+', ' ', 'g'), '[\n\r]', ' ', 'g'), ' ') AS text FROM documents"
)
def clean_cells(spark, d):
    return text.clean_cells(t(spark, d, "documents"))


@query(rf"""
WITH w AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents), s AS (SELECT *, CASE WHEN len(w) <= 110 THEN len(w) ELSE 100 END AS step FROM w WHERE len(w) > 0)
SELECT doc_id, chunk::INT AS chunk, len(w[chunk * step + 1 : chunk * step + step])::INT AS n_words, array_to_string(w[chunk * step + 1 : chunk * step + step], ' ') AS text
FROM (SELECT *, unnest(range(0, (len(w) - 1) // step + 1)) AS chunk FROM s)""")  # fmt: skip
def word_chunks(spark, d):
    return text.word_chunks(t(spark, d, "documents"), "doc_id", "text", 100, 110)


@query(rf"""
WITH s AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN lang END AS summary, {WORDS.format("text")} AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) < 200 THEN 'full' WHEN length(trim(coalesce(summary, ''))) > 0 THEN 'summary' ELSE 'cut' END AS how,
 CASE WHEN len(w) < 200 THEN text WHEN length(trim(coalesce(summary, ''))) > 0 THEN summary ELSE array_to_string(w[1:200], ' ') END AS content FROM s""")  # fmt: skip
def select_content(spark, d):
    docs = t(spark, d, "documents").withColumn("summary", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    return text.select_content(docs, "doc_id", "text", "summary", 200)


@query(rf"""
SELECT word, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(lower(regexp_replace(coalesce(text, ''), '\\u[0-9a-fA-F]{{4}}', ' ', 'g')), '[^\p{{L}}]+', ' ', 'g'), ' ')) AS word FROM documents)
WHERE word NOT IN ('n', 'u', 'r', '', {STOPS}) AND length(word) > 1 GROUP BY word ORDER BY n DESC, word LIMIT 100""")  # fmt: skip
def term_frequencies(spark, d):
    return text.term_frequencies(t(spark, d, "documents"), "text")


@query(r"""
WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b([A-Z]{2,})\s*\(([^)]+)\)', 1)) AS acronym,
  trim(unnest(regexp_extract_all(text, '\b([A-Z]{2,})\s*\(([^)]+)\)', 2)), ' ') AS expansion,
  generate_subscripts(regexp_extract_all(text, '\b([A-Z]{2,})\s*\(([^)]+)\)', 1), 1) AS pos
 FROM (SELECT doc_id, 'The ' || upper(source) || ' (' || lang || ' source) and ' || upper(source) || '(again ' || lang || ' x). ' || text AS text
   FROM (SELECT doc_id, lang, text, 'SRC' || repeat('A', 1 + (doc_id % 3)::INT) AS source FROM documents)))
SELECT doc_id, acronym, arg_max(expansion, pos) AS expansion FROM e WHERE length(expansion) > 5 GROUP BY doc_id, acronym""")  # fmt: skip
def extract_terms(spark, d):
    docs = t(spark, d, "documents").withColumn("s", F.expr("concat('SRC', repeat('A', cast(1 + doc_id % 3 as int)))"))
    docs = docs.withColumn("text", F.expr("concat('The ', s, ' (', lang, ' source) and ', s, '(again ', lang, ' x). ', text)"))
    return text.extract_terms(docs, "doc_id", "text")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
lab AS (SELECT DISTINCT doc_id, pos, unnest(regexp_extract_all(line, '^([A-Za-z]+) ', 1)) AS label FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY pos) - 1 AS n FROM lab WHERE label <> ''),
f AS (SELECT doc_id, min(pos) AS stop FROM n WHERE n >= 2 GROUP BY doc_id)
SELECT doc_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS text FROM l LEFT JOIN f USING (doc_id) WHERE stop IS NULL OR pos < stop GROUP BY doc_id""")  # fmt: skip
def cut_repetition(spark, d):
    return text.cut_repetition(t(spark, d, "documents"), "doc_id", "text", r"^([A-Za-z]+) ")


@query("""
SELECT source, 0::INT AS block, count(*) FILTER (lang <> 'en') AS n_summaries,
 coalesce(string_agg(doc_id::VARCHAR || ': ' || lang, chr(10) ORDER BY doc_id) FILTER (lang <> 'en'), '') AS summaries FROM documents GROUP BY source""")
def thread_summaries(spark, d):
    docs = t(spark, d, "documents").select("source", "doc_id", F.col("doc_id").cast("string").alias("title"), F.when(F.col("lang") != "en", F.col("lang")).alias("summary"))
    return text.thread_summaries(docs, "source", "doc_id", "title", "summary")


@query(rf"""
WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {ASCII.format("text")} AS ws FROM documents)),
n AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first)::INT AS rank, word, n FROM n QUALIFY rank <= 8""")  # fmt: skip
def document_keywords(spark, d):
    return enrich.document_keywords(t(spark, d, "documents"), "doc_id", "text")


@query(r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), chr(10))[1:5], lambda x: trim(x, ' ')), lambda x: length(x) >= 3 AND length(x) <= 120)[1] AS line FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(line, '(?i)^(\d+[.\)]\s|chapter\s+\d+|section\s+\d+)') THEN line[1:100]
 WHEN upper(line) = line AND lower(line) <> line AND length(line) > 3 AND length(line) < 80 THEN line
 WHEN length(line) < 80 AND NOT regexp_matches(line, '[.,;:!?)"'']$') THEN line ELSE '' END AS heading FROM l""")  # fmt: skip
def page_heading(spark, d):
    return enrich.page_heading(t(spark, d, "documents"), "doc_id", "text")


SUMMARY = rf"""s AS (SELECT doc_id, coalesce(text, '')[1:3000] AS st, {SENTENCES.format("coalesce(text, '')[1:3000]")} AS ss FROM documents),
e AS (SELECT doc_id, unnest(ss) AS x, generate_subscripts(ss, 1) AS i FROM s),
c AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM e),
l AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS lead FROM c WHERE n <= 500 GROUP BY doc_id),
summary AS (SELECT doc_id, -1 AS chunk_index, CASE WHEN coalesce(lead, '') = '' THEN st[1:500] ELSE lead END AS summary FROM s LEFT JOIN l USING (doc_id))"""


@query(f"WITH {SUMMARY} SELECT * FROM summary")
def summary_chunk(spark, d):
    return enrich.summary_chunk(t(spark, d, "documents"), "doc_id", "text")


@query(r"""
WITH e AS (SELECT doc_id, unnest(ns) AS name, generate_subscripts(ns, 1) - 1 AS pos FROM
 (SELECT doc_id, regexp_extract_all(text[1:5000], '\b(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)\b', 1) AS ns FROM (SELECT doc_id, 'Alpha Beta met Gamma. ' || upper(lang[1:1]) || lang[2:] || ' saw ALPHA and Alpha beta. Gamma left' AS text FROM documents))),
f AS (SELECT doc_id, lower(name) AS k, min(pos) AS pos, arg_min(name, pos) AS name FROM e WHERE length(name) >= 2 AND lower(name) NOT IN (""" + STOPS + r""") GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS rank, name FROM f QUALIFY rank <= 15""")  # fmt: skip
def entity_mentions(spark, d):
    docs = t(spark, d, "documents").withColumn("text", F.expr("concat('Alpha Beta met Gamma. ', initcap(lang), ' saw ALPHA and Alpha beta. Gamma left')"))
    return enrich.entity_mentions(docs, "doc_id", "text")


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {names_sql("d", "doc_id")},
f AS (SELECT doc_id, lower(name) AS k, min(i0) AS i0, arg_min(name, i0) AS name FROM names WHERE lower(name) NOT IN ({STOPS}) GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i0)::INT AS rank, name FROM f""")
def whole_text_mentions(spark, d):
    return enrich.entity_mentions(t(spark, d, "documents"), "doc_id", "text", head=2**31 - 1, most=2**31 - 1)


@query(rf"""
WITH w AS (SELECT DISTINCT item_id, unnest(ws) AS term FROM (SELECT item_id, {ASCII.format("text || ' Revenue and risks plan'")} AS ws FROM benchmark)),
s(term, syn) AS (VALUES {SYNONYM_ROWS})
SELECT item_id, term FROM w UNION SELECT item_id, syn FROM w JOIN s USING (term)""")  # fmt: skip
def expand_query_terms(spark, d):
    q = t(spark, d, "benchmark").withColumn("text", F.concat("text", F.lit(" Revenue and risks plan")))
    return enrich.expand_query_terms(q, "item_id", "text")


@query(rf"""
WITH s AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS sentence FROM
  (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents)),
l AS (SELECT * FROM s WHERE length(s) >= 10), {names_sql("l", "doc_id, sentence", "s")},
p AS (SELECT doc_id, sentence, row_number() OVER w - 1 AS i, name AS subject, i1, lead(name, 1) OVER w AS o1, lead(i0, 1) OVER w AS f1, lead(name, 2) OVER w AS o2, lead(i0, 2) OVER w AS f2
  FROM names WINDOW w AS (PARTITION BY doc_id, sentence ORDER BY i0)),
t AS (SELECT doc_id, sentence, i, 1 AS k, subject, i1, o1 AS object, f1 AS f FROM p WHERE o1 IS NOT NULL UNION ALL SELECT doc_id, sentence, i, 2, subject, i1, o2, f2 FROM p WHERE o2 IS NOT NULL),
a AS (SELECT doc_id, sentence, regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+') AS ws, string_split_regex(s, '[\p{{L}}\p{{N}}_]+') AS gs FROM l),
b AS (SELECT doc_id, sentence, i, k, subject, regexp_replace(array_to_string(list_transform(range(i1 + 1, f), lambda x: gs[x] || ws[x]), '') || gs[f], '^[ ,;:]+|[ ,;:]+$', '', 'g') AS predicate, object
  FROM t JOIN a USING (doc_id, sentence))
SELECT doc_id, sentence::INT AS sentence, i::INT AS i, k::INT AS k, subject, predicate, object FROM b WHERE length(predicate) BETWEEN 2 AND 80 AND regexp_matches(predicate, '\p{{L}}')""")
def entity_triples(spark, d):
    return enrich.entity_triples(t(spark, d, "documents"), "doc_id", "text")


@query("""
WITH n AS (SELECT 'r' || r_regionkey AS id, NULL AS p FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
c AS (SELECT p AS id, count(*) AS k FROM n WHERE p IS NOT NULL GROUP BY p)
SELECT n.id, CASE WHEN n.p IS NULL THEN 0 WHEN n.id LIKE 'n%' THEN 1 ELSE 2 END AS depth,
 CASE WHEN n.p IS NULL THEN n.id WHEN n.id LIKE 'n%' THEN n.p || '/' || n.id ELSE m.p || '/' || n.p || '/' || n.id END AS path,
 CASE WHEN n.p IS NULL THEN n.id WHEN n.id LIKE 'n%' THEN n.p ELSE m.p END AS root, coalesce(k, 0) AS n_children
FROM n LEFT JOIN n m ON m.id = n.p LEFT JOIN c ON c.id = n.id""")
def node_tree(spark, d):
    node = lambda df, i, p: df.select(F.expr(i).alias("id"), F.expr(p).alias("parent_id"))
    nodes = node(t(spark, d, "region"), "concat('r', r_regionkey)", "cast(null as string)")
    nodes = nodes.union(node(t(spark, d, "nation"), "concat('n', n_nationkey)", "concat('r', n_regionkey)"))
    return enrich.node_tree(spark, nodes.union(node(t(spark, d, "customer"), "concat('c', c_custkey)", "concat('n', c_nationkey)")))


@query(f"WITH {HITS} SELECT query_id, thread, chunk_id, rank::INT AS rank, score FROM top WHERE score > 0")
def bm25_topk(spark, d):
    return bm25(spark, d)


@query("""SELECT label AS owner, len(embedding)::INT AS dim, count(*) AS n, len(embedding) = 64 AS ok FROM embeddings GROUP BY ALL""")
def embedding_dim_check(spark, d):
    return retrieve.embedding_dim_check(t(spark, d, "embeddings"), "label", "embedding", 64).withColumnRenamed("label", "owner")


@query(r"""
WITH v AS (SELECT item_id, list_filter([trim(text, ' '), trim('Q: ' || text, ' '), '', trim(text, ' ')], lambda x: x <> '') AS vs FROM benchmark),
u AS (SELECT item_id, CASE WHEN len(vs) = 0 THEN [] WHEN vs[1] = vs[2] THEN [vs[1]] ELSE [vs[1], vs[2]] END AS vs FROM v)
SELECT item_id, (generate_subscripts(vs, 1) - 1)::INT AS list_id, unnest(vs) AS variant, CASE WHEN len(vs) > 1 THEN 15 ELSE 30 END AS vector_k, CASE WHEN len(vs) > 1 THEN 10 ELSE 20 END AS bm25_k FROM u""")  # fmt: skip
def query_variants(spark, d):
    q = t(spark, d, "benchmark").withColumns({"b": F.concat(F.lit("Q: "), "text"), "c": F.lit(""), "e": F.col("text")})
    return retrieve.query_variants(q, "item_id", ["text", "b", "c", "e"])


@query(f"""WITH {HITS}, two AS (SELECT query_id, chunk_id, 0 AS l, rank FROM hits UNION ALL
 SELECT query_id, chunk_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) - 1 FROM hits),
f AS (SELECT query_id, chunk_id, sum(cast(cast(1 AS DOUBLE) / (rank + 61) AS DECIMAL(28,10)))::DOUBLE AS score, min((l, rank)) AS o FROM two GROUP BY ALL)
SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, chunk_id) - 1)::INT AS rank FROM f""")  # fmt: skip
def rrf_fuse(spark, d):
    h = hits(spark, d)
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")) - 1
    two = h.select("query_id", "chunk_id", F.lit(0).alias("list_id"), "rank").union(h.select("query_id", "chunk_id", F.lit(1), again))
    return retrieve.rrf_fuse(two)


@query(f"""WITH {HITS}, b AS (SELECT *, max(score) OVER (PARTITION BY query_id, document_id) AS best, max(score) OVER (PARTITION BY query_id) AS t FROM hits),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_id) AS i FROM b WHERE best >= cast(0.25 AS DOUBLE) * t),
n AS (SELECT *, sum(CASE WHEN i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS n FROM k),
g AS (SELECT *, least(60, CASE WHEN n <= 2 THEN 40 WHEN n <= 5 THEN 80 WHEN n <= 10 THEN 150 ELSE least(60, 15 * n) END)::INT AS budget,
 (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN i = 1 THEN 0 ELSE 1 END, score DESC, chunk_id) - 1)::INT AS r FROM n)
SELECT query_id, document_id, chunk_id, page_no, score, budget, r AS rank FROM g WHERE r < budget""")  # fmt: skip
def gate_and_budget(spark, d):
    return retrieve.gate_and_budget(hits(spark, d), 60)


@query(f"""WITH {HITS}, h AS (SELECT h.*, lang, row_number() OVER (PARTITION BY query_id, text ORDER BY rank) AS r FROM hits h JOIN documents ON doc_id = chunk_id)
SELECT query_id, chunk_id FROM h WHERE r = 1""")
def dedup_content_hash(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieve.dedup_content_hash(hits(spark, d).join(docs, "chunk_id"), "text").select("query_id", "chunk_id")


@query(f"""WITH {HITS}, i AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_id) AS i FROM hits),
n AS (SELECT *, sum(CASE WHEN i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS n FROM i),
f AS (SELECT *, CASE WHEN i <= CASE WHEN n = 1 THEN 12 ELSE least(6, ceil(cast(12 AS DOUBLE) / n)) END THEN 0 ELSE 1 END AS fill FROM n),
g AS (SELECT query_id, document_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY fill, score DESC, chunk_id) - 1)::INT AS r FROM f)
SELECT query_id, document_id, chunk_id, r AS rank FROM g WHERE r < 12""")  # fmt: skip
def balanced_topk(spark, d):
    return retrieve.balanced_topk(hits(spark, d)).select("query_id", "document_id", "chunk_id", "rank")


@query(f"WITH {HITS} SELECT query_id, chunk_id, round(1 - rank::DOUBLE / count(*) OVER (PARTITION BY query_id), 6) AS rerank_score FROM hits")
def score_pairs(spark, d):
    return retrieve.score_pairs(hits(spark, d)).select("query_id", "chunk_id", "rerank_score")


@query(f"""WITH {HITS}, q AS (SELECT item_id AS query_id, list_filter(list_distinct(string_split(text, ' ')), lambda x: x <> '') AS ws FROM benchmark),
d AS (SELECT doc_id AS chunk_id, list_distinct(string_split(coalesce(text, ''), ' ')) AS ts FROM documents)
SELECT query_id, chunk_id, round(1 / (1 + exp(-(8 * len(list_intersect(ws, ts))::DOUBLE / greatest(1, len(ws)) - 4))), 6) AS rerank_score FROM hits JOIN q USING (query_id) JOIN d USING (chunk_id)""")
def score_pairs_scorer(spark, d):
    """Every hit scored by a scorer of pairs, its text joined late."""
    h = hits(spark, d).join(t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    h = h.join(t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    return retrieve.score_pairs(h, retrieve.overlap_scorer).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"))


@query(f"""WITH {HITS}, s AS (SELECT query_id, count(*) AS n, round(sum(cast(score AS DECIMAL(28,10)))::DOUBLE / count(*), 6) AS mean FROM hits GROUP BY query_id)
SELECT *, CASE WHEN n >= 5 AND mean >= 0.5 THEN 'high' WHEN n >= 3 AND mean >= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM s""")
def retrieval_confidence(spark, d):
    return retrieve.retrieval_confidence(hits(spark, d))


@query(f"""WITH {HITS}, h AS (SELECT hits.*, text[1:100] AS k FROM hits JOIN documents ON doc_id = chunk_id), a AS (SELECT * FROM h WHERE rank < 10), b AS (SELECT * FROM h WHERE rank >= 5)
SELECT query_id, document_id, chunk_id, page_no FROM a UNION ALL SELECT query_id, document_id, chunk_id, page_no FROM b
WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id AND a.document_id = b.document_id AND a.page_no = b.page_no AND a.k = b.k)""")
def merge_rounds(spark, d):
    h = hits(spark, d).join(t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    return retrieve.merge_rounds(h.where("rank < 10"), h.where("rank >= 5"), "text").select("query_id", "document_id", "chunk_id", "page_no")


@query(f"""WITH {HITS}, h AS (SELECT hits.*, query_id // 4 AS g, text[1:100] AS k FROM hits JOIN documents ON doc_id = chunk_id)
SELECT query_id, chunk_id, g FROM h QUALIFY row_number() OVER (PARTITION BY g, document_id, page_no, k ORDER BY score DESC, query_id, chunk_id) = 1""")
def dedup_subqueries(spark, d):
    h = hits(spark, d).join(t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id").withColumn("g", F.expr("query_id div 4"))
    return retrieve.dedup_subqueries(h, "g", "text").select("query_id", "chunk_id", "g")


@query(f"""WITH {HITS}, p AS (SELECT *, sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS p, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM hits)
SELECT query_id, chunk_id, score FROM p WHERE (p >= 2 AND score >= 0.5) OR (p < 2 AND r <= 2)""")
def filter_low_scores(spark, d):
    return retrieve.filter_low_scores(hits(spark, d)).select("query_id", "chunk_id", "score")


@query(f"""WITH {HITS}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM hits)
SELECT query_id, chunk_id, (CASE WHEN n <= 2 THEN rank WHEN rank % 2 = 0 THEN rank // 2 ELSE n - 1 - (rank - 1) // 2 END)::INT AS position FROM n""")
def edge_order(spark, d):
    return retrieve.edge_order(hits(spark, d)).select("query_id", "chunk_id", "position")


@query("SELECT item_id, text, greatest(0, 118000 - ceil(length(coalesce(text, ''))::DOUBLE / 4))::BIGINT AS budget FROM benchmark")
def token_budget(spark, d):
    return retrieve.token_budget(t(spark, d, "benchmark"), "text")


@query(f"""WITH {HITS}, c AS (SELECT DISTINCT query_id, document_id, page_no FROM hits WHERE page_no < 5)
SELECT query_id, document_id, page_no, chunk_id FROM c JOIN hits USING (query_id, document_id, page_no) QUALIFY row_number() OVER (PARTITION BY query_id, document_id, page_no ORDER BY rank) = 1""")
def cite(spark, d):
    h = hits(spark, d)
    return retrieve.cite(h.where("page_no < 5"), h).select("query_id", "document_id", "page_no", "chunk_id")


@query(f"""WITH {HITS}, s AS (SELECT query_id, count(*) AS n, round(sum(cast(score AS DECIMAL(28,10)))::DOUBLE / count(*), 6) AS mean FROM hits GROUP BY query_id),
l AS (SELECT query_id // 4 AS g, CASE WHEN n >= 5 AND mean >= 0.5 THEN 2 WHEN n >= 3 AND mean >= 0.3 THEN 1 ELSE 0 END AS v FROM s)
SELECT g, ['low', 'medium', 'high'][min(v) + 1] AS confidence FROM l GROUP BY g""")
def confidence_rollup(spark, d):
    levels = retrieve.retrieval_confidence(hits(spark, d)).withColumn("g", F.expr("query_id div 4"))
    return retrieve.confidence_rollup(levels, "g")


@query(f"""WITH {HITS}, p AS (SELECT query_id, document_id, page_no, min(rank) AS first FROM hits WHERE score >= 0.8 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first, document_id, page_no)::INT AS pos, document_id, page_no FROM p QUALIFY pos <= 5""")
def visual_pages(spark, d):
    return retrieve.visual_pages(hits(spark, d))


def _likes(words):
    return "(" + " OR ".join(f"contains(lo, '{w}')" for w in words) + ")"


@query(rf"""WITH c AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS lo, coalesce(text, '') AS text FROM conversations WHERE role = 'user')
SELECT conv_id, turn, {_likes(retrieve.NLP_WORDS)} AS is_nlp, {_likes(retrieve.EXCEL_WORDS)} AS is_excel,
 CASE {" ".join(f"WHEN {_likes(v)} THEN '{k}'" for k, v in retrieve.STYLES.items())} ELSE 'detailed' END AS style,
 CASE WHEN regexp_extract(text, '{retrieve.PAGE}', 4) <> '' THEN 1 ELSE coalesce(nullif(regexp_extract(text, '{retrieve.PAGE}', 1), ''), nullif(regexp_extract(text, '{retrieve.PAGE}', 2), ''))::INT END AS page,
 regexp_extract(text, '{retrieve.PAGE}', 3) <> '' AS is_last, NOT regexp_matches(text, '{retrieve.PAGE}') AND regexp_matches(text, '{retrieve.IMPLICIT}') AS is_implicit FROM
 (SELECT conv_id, turn, lower(coalesce(text, '') || e) AS lo, coalesce(text, '') || e AS text FROM conversations,
   (VALUES (0, ' see the first page'), (1, ' on slide 12'), (2, ' the final slide'), (3, ' in the chart'), (4, ' 2nd page as Excel')) AS v(k, e) WHERE role = 'user' AND k = conv_id % 5)""")  # fmt: skip
def query_flags(spark, d):
    ends = F.array(*[F.lit(x) for x in (" see the first page", " on slide 12", " the final slide", " in the chart", " 2nd page as Excel")])
    asked = t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    asked = asked.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.get(ends, (F.col("conv_id") % 5).cast("int"))))
    return retrieve.query_flags(asked, "text").drop("text")


@query(f"""WITH {HITS}, b AS (SELECT query_id, arg_min(document_id, (rank, chunk_id)) AS document_id, arg_min(page_no, (rank, chunk_id)) AS own FROM hits GROUP BY query_id),
l AS (SELECT query_id, document_id, max(page_no) AS last FROM hits GROUP BY ALL)
SELECT query_id, document_id, CASE WHEN query_id % 3 = 0 THEN 7 WHEN query_id % 3 = 1 THEN last ELSE own END::INT AS page_no FROM b JOIN l USING (query_id, document_id)""")
def target_page(spark, d):
    flags = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, 7).alias("page"), (F.col("item_id") % 3 == 1).alias("is_last"))
    return retrieve.target_page(hits(spark, d), flags)


SIMS = f"""w AS (SELECT query_id, chunk_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS term FROM hits JOIN documents ON doc_id = chunk_id),
f AS (SELECT query_id, chunk_id, term, count(*) AS tf FROM w GROUP BY ALL), z AS (SELECT query_id, chunk_id, sum(tf) AS len FROM f GROUP BY ALL),
n AS (SELECT query_id, count(*) AS n FROM hits GROUP BY query_id), df AS (SELECT query_id, term, count(*) AS df FROM f GROUP BY ALL),
x AS (SELECT query_id, chunk_id, term, tf::DOUBLE / len * ln((n + 1)::DOUBLE / (df + 1)) AS w FROM f JOIN z USING (query_id, chunk_id) JOIN df USING (query_id, term) JOIN n USING (query_id)),
m AS (SELECT query_id, chunk_id, sqrt(sum(cast(w * w AS DECIMAL(28,18)))::DOUBLE) AS norm FROM x WHERE w <> 0 GROUP BY ALL),
sims AS (SELECT a.query_id, a.chunk_id AS a, b.chunk_id AS b, round(sum(cast(a.w * b.w AS DECIMAL(28,18)))::DOUBLE / (any_value(p.norm) * any_value(q.norm)), 6) AS sim
FROM x a JOIN x b ON a.query_id = b.query_id AND a.term = b.term AND a.chunk_id < b.chunk_id JOIN m p ON p.query_id = a.query_id AND p.chunk_id = a.chunk_id JOIN m q ON q.query_id = b.query_id AND q.chunk_id = b.chunk_id
WHERE a.w <> 0 AND b.w <> 0 GROUP BY 1, 2, 3)"""


@query(f"WITH {HITS}, {SIMS} SELECT * FROM sims")
def tfidf_cosine(spark, d):
    h = hits(spark, d).join(t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    return retrieve.tfidf_cosine(h, "text")


@query(f"""WITH RECURSIVE {HITS}, {SIMS}, c AS (SELECT query_id, chunk_id, round(1 - rank::DOUBLE / count(*) OVER (PARTITION BY query_id), 6) AS s FROM hits),
y AS (SELECT query_id, a, b, sim FROM sims UNION ALL SELECT query_id, b, a, sim FROM sims),
r(query_id, k, chosen) AS (SELECT DISTINCT query_id, 0, []::BIGINT[] FROM c UNION ALL
 SELECT query_id, k + 1, list_append(any_value(chosen), arg_max(chunk_id, (v, s, -chunk_id))) FROM (
  SELECT r.query_id, r.k, r.chosen, c.chunk_id, c.s, cast(0.5 AS DOUBLE) * c.s - cast(0.5 AS DOUBLE) * greatest(0, coalesce(max(y.sim), 0)) AS v
  FROM r JOIN c USING (query_id) LEFT JOIN y ON y.query_id = c.query_id AND y.a = c.chunk_id AND list_contains(r.chosen, y.b) WHERE k < 10 AND NOT list_contains(chosen, c.chunk_id) GROUP BY 1, 2, 3, 4, 5) GROUP BY query_id, k),
l AS (SELECT query_id, arg_max(chosen, k) AS chosen FROM r GROUP BY query_id)
SELECT query_id, unnest(chosen) AS chunk_id, (generate_subscripts(chosen, 1) - 1)::INT AS mmr_rank FROM l""")
def mmr_select(spark, d):
    h = hits(spark, d).join(t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    return retrieve.mmr_select(retrieve.score_pairs(h), retrieve.tfidf_cosine(h, "text"))


@query(f"""WITH RECURSIVE {HITS}, t AS (SELECT query_id, document_id, max(score) AS s, sum(ceil(length(text)::DOUBLE / 4))::BIGINT AS tokens FROM hits JOIN documents ON doc_id = chunk_id GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, document_id) AS i FROM t),
r(query_id, document_id, tokens, i, batch, used) AS (SELECT query_id, document_id, tokens, i, 0::BIGINT, tokens FROM o WHERE i = 1 UNION ALL
 SELECT o.query_id, o.document_id, o.tokens, o.i, CASE WHEN used + o.tokens <= 5000 THEN batch ELSE batch + 1 END, CASE WHEN used + o.tokens <= 5000 THEN used + o.tokens ELSE o.tokens END
 FROM r JOIN o ON o.query_id = r.query_id AND o.i = r.i + 1)
SELECT query_id, document_id, tokens, batch FROM r""")
def pack_batches(spark, d):
    h = hits(spark, d).join(t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    return retrieve.pack_batches(h, 8000)


@query(r"""WITH c AS (SELECT c_custkey AS pos, c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ' (x)' ELSE '' END AS name, 's' || c_custkey // 30 AS sheet_id FROM customer),
b AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(name, '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')) AS base FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, base ORDER BY pos) AS n FROM b)
SELECT sheet_id, pos, name, base || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS clean FROM n""")
def sanitize_names(spark, d):
    c = t(spark, d, "customer").select(F.expr("concat('s', c_custkey div 30)").alias("sheet_id"), F.col("c_custkey").alias("pos"), F.expr("concat(c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN ' (x)' ELSE '' END)").alias("name"))
    return tables.sanitize_names(c)


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, c_custkey::VARCHAR AS Column_3 FROM customer WHERE c_custkey IS NOT NULL")
def repair_table(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"), F.lit(None).cast("string").alias("nothing"), F.col("c_custkey").cast("string").alias("Unnamed: 3"))
    return tables.repair_table(c)


@query("SELECT p_partkey, p_name, p_size::BIGINT AS p_size, p_retailprice, p_size > 20 AS big, '00' || p_size AS code FROM part")
def infer_types(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice", (F.col("p_size") > 20).alias("big"), F.expr("concat('00', p_size)").alias("code"))
    return tables.infer_types(p.select(*[F.col(c).cast("string").alias(c) for c in p.columns]))


@query("SELECT n_nationkey, concat_ws(' | ', 'n_nationkey: ' || n_nationkey, 'n_name: ' || n_name, 'n_regionkey: ' || n_regionkey) AS row_text FROM nation")
def rows_to_strings(spark, d):
    return tables.rows_to_strings(t(spark, d, "nation"), ["n_nationkey"])


@query("SELECT o_orderpriority, sum(cast(o_totalprice AS DECIMAL(28,10)))::DOUBLE AS o_totalprice, count(o_custkey) AS o_custkey FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority")
def pivot_aggregate(spark, d):
    return tables.pivot_aggregate(t(spark, d, "orders"), ["o_orderpriority", "missing"], {"o_totalprice": "sum", "o_custkey": "count", "none": "sum"})


@query("SELECT c_name, c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def arrange_sheet(spark, d):
    return tables.arrange_sheet(t(spark, d, "customer"), ["c_name", "gone"], "-c_acctbal")


@query("""SELECT 'nation' AS sheet, unnest(['Rows', 'n_nationkey sum', 'n_nationkey mean', 'n_regionkey sum', 'n_regionkey mean']) AS metric,
 unnest([count(*)::DOUBLE, sum(n_nationkey)::DOUBLE, round(avg(n_nationkey), 6), sum(n_regionkey)::DOUBLE, round(avg(n_regionkey), 6)]) AS value FROM nation UNION ALL
SELECT 'supplier', unnest(['Rows', 's_suppkey sum', 's_suppkey mean', 's_nationkey sum', 's_nationkey mean', 's_acctbal sum', 's_acctbal mean']),
 unnest([count(*)::DOUBLE, sum(s_suppkey)::DOUBLE, round(avg(s_suppkey), 6), sum(s_nationkey)::DOUBLE, round(avg(s_nationkey), 6), sum(cast(s_acctbal AS DECIMAL(28,10)))::DOUBLE, round(sum(cast(s_acctbal AS DECIMAL(28,10)))::DOUBLE / count(*), 6)]) FROM supplier""")
def summary_metrics(spark, d):
    return tables.summary_metrics({n: t(spark, d, n) for n in ("nation", "supplier")})


@query("SELECT l_orderkey, l_linenumber, 'EUR' AS currency, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def add_columns(spark, d):
    li = tables.add_columns(t(spark, d, "lineitem"), {"currency": "EUR"}, {"net": "l_extendedprice * (1 - l_discount)"})
    return li.select("l_orderkey", "l_linenumber", "currency", "net")


@query("""SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 'N/A' WHEN contains(text, '?') THEN 'question' WHEN length(text) > 200 THEN 'long' ELSE 'other' END AS label FROM conversations""")
def label_rows(spark, d):
    return tables.label_rows(t(spark, d, "conversations"), "text", tables.keyword_labeler).select("conv_id", "turn", "label")


@query("""WITH b AS (SELECT user_id % 7 AS batch, event_type AS theme, count(*) AS c, list_sort(list(DISTINCT user_id::VARCHAR)) AS ex FROM events GROUP BY 1, 2),
s AS (SELECT lower(trim(theme)) AS k, sum(c) AS n FROM b GROUP BY k), x AS (SELECT lower(trim(theme)) AS k, batch, unnest(ex) AS x, generate_subscripts(ex, 1) AS pos FROM b),
f AS (SELECT k, x, min((batch, pos)) AS o FROM x GROUP BY k, x), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, x) AS r FROM f QUALIFY r <= 3)
SELECT k AS theme, any_value(n)::BIGINT AS n, round(100 * any_value(n) / (SELECT count(*) FROM events), 1) AS percent, string_agg(x, '|' ORDER BY r) AS examples FROM s JOIN r USING (k) GROUP BY k""")
def merge_themes(spark, d):
    e = t(spark, d, "events")
    b = e.groupBy((F.col("user_id") % 7).alias("batch"), F.col("event_type").alias("theme")).agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set(F.col("user_id").cast("string"))).alias("examples"))
    return tables.merge_themes(b).withColumn("examples", F.array_join("examples", "|"))


@query("""WITH n AS (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS r FROM events)
SELECT event_id, event_type, (CASE WHEN n < 100 THEN 0 ELSE least(r // (n // ceil(n::DOUBLE / 200)::BIGINT), ceil(n::DOUBLE / 200)::BIGINT - 1) END)::INT AS batch FROM n""")
def batch_rows(spark, d):
    return tables.batch_rows(t(spark, d, "events"), "event_type", ["ts", "event_id"]).select("event_id", "event_type", "batch")


@query("""SELECT 'customer' AS sheet, unnest(['Workbook: 2 sheets', '- customer: c_custkey, c_name, c_mktsegment', '- region: r_regionkey, r_name', 'Sheet: customer', 'Columns: c_custkey, c_name, c_mktsegment', 'Rows: ' || count(*), '', '| c_custkey | c_name | c_mktsegment |', '| --- | --- | --- |']) AS line FROM customer
UNION ALL SELECT 'customer', '| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' |' FROM customer""")
def sheet_text(spark, d):
    return _customer_sheet(spark, d).select("sheet", F.explode(F.split("text", "\n")).alias("line"))


def _customer_sheet(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    summary = tables.workbook_summary({"customer": c, "region": t(spark, d, "region")})
    return tables.sheet_text(c, "customer", ["c_custkey"], summary=summary)


@query("SELECT 'customer' AS sheet, c_custkey::VARCHAR AS a, c_name AS b, c_mktsegment AS c FROM customer")
def parse_markdown_result(spark, d):
    head = "| a | b | c |\n| --- | --- | --- |\n"
    block = _customer_sheet(spark, d).withColumn("text", F.when(F.col("block") > 0, F.concat(F.lit(head), "text")).otherwise(F.col("text")))
    out = tables.parse_markdown_result(block.select(F.struct("sheet", "block").alias("at"), "text"), "at", "text")
    return out.select("at.sheet", *[F.col("cells")[i].alias(c) for i, c in enumerate("abc")])


@query("""WITH s AS (SELECT o_orderpriority AS x, sum(cast(o_totalprice AS DECIMAL(28,10)))::DOUBLE AS a, count(o_custkey)::DOUBLE AS b FROM orders GROUP BY 1)
SELECT x, 'o_totalprice' AS series, a AS value FROM s UNION ALL SELECT x, 'o_custkey', b FROM s""")
def chart_series(spark, d):
    return tables.chart_series(pivot_aggregate(spark, d), "o_orderpriority", ["o_totalprice", "o_custkey"])


@query("""WITH c AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer), n AS (SELECT * FROM nation)
SELECT 'customer' AS table_name, 'c_custkey (bigint), c_name (string), c_nationkey (int), c_mktsegment (string)' AS columns, count(*) AS n_rows,
 (SELECT string_agg(j, chr(10) ORDER BY c_custkey) FROM (SELECT c_custkey, json_object('c_custkey', c_custkey, 'c_name', c_name, 'c_nationkey', c_nationkey, 'c_mktsegment', c_mktsegment)::VARCHAR AS j FROM c ORDER BY c_custkey LIMIT 3)) AS sample FROM c
UNION ALL SELECT 'nation', 'n_nationkey (int), n_name (string), n_regionkey (int)', count(*),
 (SELECT string_agg(j, chr(10) ORDER BY n_nationkey) FROM (SELECT n_nationkey, json_object('n_nationkey', n_nationkey, 'n_name', n_name, 'n_regionkey', n_regionkey)::VARCHAR AS j FROM n ORDER BY n_nationkey LIMIT 3)) FROM n""")
def describe_tables(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return tables.describe_tables({"customer": c.withColumn("c_custkey", F.col("c_custkey").cast("bigint")), "nation": t(spark, d, "nation")})


@query("""WITH d AS (SELECT doc_id, lang FROM documents)
SELECT doc_id, unnest([1, 1, 1, 2, 2]) AS table_no, unnest([0, 1, 2, 0, 1]) AS row, unnest(['doc|lang', doc_id || '|' || lang, 'more|', 'A|B', '1|' || doc_id]) AS cells FROM d WHERE doc_id % 5 <> 0
UNION ALL SELECT doc_id, 1, unnest([0, 1, 2]), unnest(['h1|h2', 'v1|' || lang, 'v2|x']) FROM d WHERE doc_id % 5 = 0""")
def extract_tables(spark, d):
    """Four of five documents hold a Markdown table and a tagged one, the fifth loose lines alone."""
    strict = "'\\n| h |\\nno table\\n\\n| doc | lang |\\n|---|---|\\n| ', doc_id, ' | ', lang, ' | x |\\n\\n| more |\\nend [Table]\\nA | B\\n1 | ', doc_id, '\\n[/Table]'"
    spaced = "'\\n| h |\\nend\\nh1 | h2\\n--- | ---\\nv1 | ', lang, '\\n\\nv2 | x | y\\n[x | y]\\nz | z'"
    body = F.expr(f"CASE WHEN doc_id % 5 <> 0 THEN concat(translate(text, '|[', ''), {strict}) ELSE concat(translate(text, '|[', ''), {spaced}) END")
    out = tables.extract_tables(t(spark, d, "documents").withColumn("text", F.coalesce(body, F.lit(""))), "doc_id", "text")
    return out.withColumn("cells", F.array_join("cells", "|"))


@query("SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def recent_history(spark, d):
    return chat.recent_history(t(spark, d, "conversations"), "conv_id", "turn")


@query("SELECT *, count(*) OVER (PARTITION BY conv_id) AS total, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS idx FROM conversations QUALIFY idx >= 1 AND idx < 4")
def page_chats(spark, d):
    return chat.page_chats(t(spark, d, "conversations"), "conv_id", "turn", 1, 3)


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, turn, role, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS idx FROM i WHERE i <> conv_id % 5""")
def delete_chats(spark, d):
    c = t(spark, d, "conversations")
    gone = c.select("conv_id").distinct().withColumn("idx", (F.col("conv_id") % 5).cast("int"))
    return chat.delete_chats(c, gone, "conv_id", "turn")


@query("""SELECT conv_id, 0::BIGINT AS block, string_agg('## ' || CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ' (' || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(60 * turn), '%Y-%m-%d %H:%M:%S') || ')' || chr(10) || chr(10) ||
 coalesce(text, '') || chr(10) || chr(10) || CASE WHEN role <> 'user' THEN '### Sources Used' || chr(10) || '- **' || role || '** (Page ' || turn || ')' || chr(10) || '- **Untitled** (Page ?)' || chr(10) || chr(10) ELSE '' END || '---' || chr(10) || chr(10), '' ORDER BY turn) AS transcript
FROM conversations GROUP BY conv_id""")
def export_transcripts(spark, d):
    c = t(spark, d, "conversations").withColumn("at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(turn as int), 0)"))
    none = F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("bigint").alias("page_no"))
    c = c.withColumn("sources", F.array(F.struct(F.col("role").alias("title"), F.col("turn").alias("page_no")), none))
    return chat.export_transcripts(c, "conv_id", "turn", "role", "text", "at", "sources")


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, (conv_id % 9)::INT - 1 AS idx FROM n WHERE conv_id % 9 - 1 < 0 OR conv_id % 9 - 1 >= n""")
def ignored_deletes(spark, d):
    c = t(spark, d, "conversations")
    return chat.ignored_deletes(c, c.select("conv_id").distinct().withColumn("idx", (F.col("conv_id") % 9).cast("int") - 1), "conv_id")


@query(rf"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER w AS b, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, concat_ws(' | ', '...' || ({SENTENCES.format("b")})[-1][1:100], ({SENTENCES.format("a")})[1][1:100] || '...') AS context FROM c""")
def adjacent_context(spark, d):
    return enrich.adjacent_context(t(spark, d, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "context")


@query("""SELECT conv_id, turn, concat_ws(chr(10), 'Document: ' || role, 'Page: ' || turn || '/9', CASE WHEN conv_id % 2 = 0 THEN 'Section: ' || conv_id END, 'Context: ...') || chr(10) || chr(10) || text AS text FROM conversations""")
def enriched_text(spark, d):
    section = F.when(F.col("conv_id") % 2 == 0, F.col("conv_id").cast("string"))
    made = enrich.enriched_text(F.col("role"), F.col("turn"), F.lit(9), section, F.lit(""), F.lit("..."), F.col("text"))
    return t(spark, d, "conversations").select("conv_id", "turn", made.alias("text"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents),
m AS (SELECT source, ceil(length(string_agg(coalesce(text, ''), chr(10) ORDER BY r))::DOUBLE / 4) / count(*) AS mean FROM r WHERE r < 20 GROUP BY source)
SELECT doc_id, (r // greatest(10, floor(cast(18000 AS DOUBLE) / greatest(1, mean)))::BIGINT)::INT AS batch FROM r JOIN m USING (source)""")
def batch_rows_by_tokens(spark, d):
    docs = t(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return tables.batch_rows_by_tokens(docs, "source", ["doc_id"], "text", 20_000).select("doc_id", "batch")


@query(f"""WITH documents AS (SELECT * FROM main.documents WHERE NOT (source IN ('src1', 'src2') AND doc_id % 3 = 0)), {HITS.split("qt AS")[0].strip().rstrip(",")}
SELECT thread, term, chunk_id, round(w, 6) AS weight FROM post""")
def delete_cascade(spark, d):
    """Chunks and postings after deletions in two threads: the postings as an index built anew has them."""
    docs = t(spark, d, "documents").select(F.col("source").alias("thread_id"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"), "text")
    left = readers.delete_cascade({"chunks": docs, "postings": retrieve.bm25_index(docs, "thread_id", "chunk_id", "text")}, docs.where("thread_id IN ('src1', 'src2') AND document_id % 3 = 0"))
    return left["postings"].select("thread", "term", "chunk_id", F.round("weight", 6).alias("weight"))


@query()
def text_embedder(spark, d):
    """The default embedder over all documents, by slot."""
    v, _ = retrieve.hashed_embeddings(t(spark, d, "documents"), "doc_id", "text", 64)
    return v.select("doc_id", F.posexplode("v").alias("slot", "value")).where("value <> 0")


@query("SELECT source, bool_or(lang = 'en') AS has_sheets, bool_and(lang = 'en') AS only_sheets FROM documents GROUP BY source")
def thread_profile(spark, d):
    docs = t(spark, d, "documents").withColumn("name", F.when(F.col("lang") == "en", "a.CSV").otherwise("b.pdf"))
    return chat.thread_profile(docs, "source", "name")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'sql_query' WHEN 'view' THEN 'web_search' WHEN 'error' THEN 'failure' ELSE lower(event_type) END AS action FROM events""")
def normalize_actions(spark, d):
    e = t(spark, d, "events").withColumn("a", F.when(F.col("event_type") == "click", " SQL ").when(F.col("event_type") == "view", "Google").otherwise(F.upper("event_type")))
    return chat.normalize_actions(e, "a").select("event_id", "action")


@query("""SELECT conv_id, turn, coalesce(text, '') || chr(10) || chr(10) || 'x "y" a/b' || chr(9) AS answer FROM conversations""")
def normalize_answers(spark, d):
    c = t(spark, d, "conversations").withColumn("raw", F.concat(F.coalesce("text", F.lit("")), F.lit('\\n\\n\\n\\nx \\"y\\" a\\/b\\t')))
    return chat.normalize_answers(c, "raw", "answer").select("conv_id", "turn", "answer")


@query("SELECT conv_id, turn, coalesce(text, '') AS answer FROM conversations")
def parse_responses(spark, d):
    c = t(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    raw = F.concat(F.lit("<think>{x}</think> Sure: ```json\n"), F.to_json(F.struct(F.col("text").alias("answer"))), F.lit("\n``` done {"))
    return chat.parse_responses(c.withColumn("raw", raw), "raw", "answer string").select("conv_id", "turn", F.col("parsed.answer").alias("answer"))


@query("""SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS text FROM documents""")
def upsert_chunks(spark, d):
    old = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("text"))
    return readers.upsert_chunks(old, old.where("chunk_id % 3 = 0").withColumn("text", F.upper("text")))


@query("SELECT doc_id, source FROM documents WHERE doc_id % 4 <> 1")
def delete_documents(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source")
    return readers.delete_documents(docs, docs.where("doc_id % 4 = 1"), ["doc_id"])


@query("""SELECT doc_id::VARCHAR AS chunk_id, source AS thread_id, doc_id AS document_id FROM documents UNION ALL
SELECT 'dst_' || doc_id, 'dst', doc_id FROM documents WHERE source = 'src1'""")
def copy_documents(spark, d):
    c = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("thread_id"), F.col("doc_id").alias("document_id"))
    asked = c.where("thread_id = 'src1'").select(F.col("thread_id").alias("src"), F.lit("dst").alias("dst"), "document_id")
    same = c.select(F.col("thread_id").alias("src"), F.col("thread_id").alias("dst"), "document_id")
    return readers.copy_documents(c, asked.union(same))


@query(r"""WITH c AS (SELECT page_id, coalesce(html, '') AS h, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<head\b[^>]*>.*?</head>', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', ' ', 'g') AS c FROM pages),
b AS (SELECT page_id, h, regexp_replace(regexp_replace(c, '(?i)</?(p|div|br|h[1-6]|li|ul|ol|table|tr|article|section|nav|footer|header)\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g') AS c FROM c),
e AS (SELECT page_id, h, replace(replace(replace(replace(replace(replace(replace(replace(c, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS c FROM b)
SELECT page_id, regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_replace(regexp_replace(regexp_replace(c, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM e""")
def page_text(spark, d):
    return readers.page_text(t(spark, d, "pages"), "page_id", "html")


@query("""WITH RECURSIVE p AS (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: trim(s, ' ') <> '') AS ps FROM documents WHERE length(text) > 5000)),
r(doc_id, i, page, used, x) AS (SELECT doc_id, i, 1, length(x), x FROM p WHERE i = 1 UNION ALL
 SELECT p.doc_id, p.i, CASE WHEN used + length(p.x) + 1 <= 3000 THEN page ELSE page + 1 END, CASE WHEN used + length(p.x) + 1 <= 3000 THEN used + length(p.x) + 1 ELSE length(p.x) END, p.x FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1)
SELECT doc_id, page AS page_no, string_agg(x, chr(10) ORDER BY i) AS text FROM r GROUP BY doc_id, page UNION ALL SELECT doc_id, 1, coalesce(text, '') FROM documents WHERE length(coalesce(text, '')) <= 5000""")
def paginate_text(spark, d):
    return text.paginate_text(t(spark, d, "documents"), "doc_id", "text", 5000, 3000, "\n")


@query()
def chunk_hierarchical(spark, d):
    return text.chunk_hierarchical(t(spark, d, "documents"), "doc_id", "text")


@query(r"""WITH s AS (SELECT doc_id, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS i FROM
 (SELECT doc_id, list_filter(list_transform(range(0, ceil(length(t) / cast(300 AS DOUBLE))::BIGINT), lambda k: t[k * 300 + 1:(k + 1) * 300]), lambda x: x <> '') AS ss
  FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\s', 'x', 'g') AS t FROM documents)))
SELECT doc_id, i::INT AS parent_idx, 0 AS child_idx, i::INT AS chunk_index, text, lag(text) OVER w AS before, lead(text) OVER w AS after FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def chunk_pages(spark, d):
    """Texts without blanks or separators of sentences fall into plain pieces of the parents' size, with their neighbours."""
    docs = t(spark, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "x").alias("text"))
    return text.chunk_pages(docs, "text", (300, 0), (300, 0)).select("doc_id", "parent_idx", "child_idx", "chunk_index", "text", "before", "after")


@query("""WITH RECURSIVE s(source, doc_id, len, k) AS (SELECT source, doc_id, length(coalesce(text, '')), 0 FROM documents UNION ALL
 SELECT source, doc_id, CASE WHEN len > 10 THEN greatest(0, len - greatest(10, ceil((total - 19000)::DOUBLE * 4 / n)::BIGINT)) ELSE len END, k + 1
 FROM (SELECT *, sum(ceil(len::DOUBLE / 4)::BIGINT) OVER w AS total, count(*) OVER w AS n, bool_or(len > 10) OVER w AS more FROM s WINDOW w AS (PARTITION BY source)) WHERE total > 19000 AND more)
SELECT source, doc_id, coalesce(text, '')[1:len] AS text FROM (SELECT doc_id, arg_max(len, k) AS len FROM s GROUP BY doc_id) JOIN documents USING (doc_id)""")
def fit_token_budget(spark, d):
    return text.fit_token_budget(t(spark, d, "documents"), "source", "doc_id", "text", 20_000)


@query("""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s, max(ts) AS ts FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN s = 'click' AND epoch(TIMESTAMP '2024-06-01 00:00:00') - epoch(ts) > 480 THEN 'failed' WHEN s = 'click' THEN 'pending' ELSE s END AS status,
 CASE WHEN s = 'click' AND epoch(TIMESTAMP '2024-06-01 00:00:00') - epoch(ts) > 480 THEN 'generation timed out' END AS message FROM l""")
def generation_status(spark, d):
    e = t(spark, d, "events").withColumn("s", F.when(F.col("event_type") == "click", "pending").otherwise(F.col("event_type")))
    return status.generation_status(e, "user_id", "ts", "s", "2024-06-01 00:00:00", "event_id")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS chunk_id, round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= 10""")
def vector_topk(spark, d):
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    asked = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))
    return retrieve.vector_topk(v, asked)


@query("""WITH q AS (SELECT vec_id AS query_id, label, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS chunk_id, round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings JOIN q USING (label))
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= 10""")
def vector_topk_scoped(spark, d):
    """The same within the document (label) of each query."""
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label")
    asked = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"), "label")
    return retrieve.vector_topk(v, asked, scope=["label"])


@query("SELECT count(*) AS n_queries, true AS found, true AS pruned FROM embeddings WHERE vec_id % 20 = 0")
def vector_cells(spark, d):
    """Stored cells against the exact search: the mean recall at 10 is 0.95 or more. The invented vectors
    hardly form groups, so that takes 24 of 32 cells (16 find nine tenths); each query still leaves a quarter out."""
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label")
    asked = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))
    path = readers.scratch(spark, "cells")
    n_cells, probes = 32, 24
    cells.build_cells(v, path, n_cells)
    got = cells.recall(cells.cell_topk(spark, path, asked, 10, probes), retrieve.vector_topk(v, asked, 10))
    return got.agg(F.count(F.lit(1)).alias("n_queries"), (F.avg("recall") >= 0.95).alias("found")).withColumn("pruned", F.lit(probes < n_cells))


@query(f"""WITH {HITS}, k AS (SELECT item_id AS query_id, {ASCII.format("text")} AS kws FROM benchmark),
b AS (SELECT h.query_id, chunk_id, round(score * (1 + cast(0.25 AS DOUBLE) * (chunk_id % 2) + least(cast(0.3 AS DOUBLE), cast(0.1 AS DOUBLE) * len(list_filter(kws, lambda w: contains(lower(text), w))))), 8) AS score
 FROM hits h JOIN documents ON doc_id = chunk_id JOIN k USING (query_id))
SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1)::INT AS rank FROM b""")
def boost_hits(spark, d):
    from docmill.functions.words import ascii_words

    k = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), ascii_words("text").alias("kws"))
    h = hits(spark, d).join(t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id").join(k, "query_id")
    return retrieve.boost_hits(h, F.col("chunk_id") % 2, F.col("kws"), F.col("text")).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {HITS}, h AS (SELECT *, rank % 3 AS parent_idx, 'P' || (rank % 3) AS parent_text FROM hits),
p AS (SELECT query_id, document_id, page_no, parent_idx, max(score) AS s, count(*) AS n, min(parent_text) AS t FROM h GROUP BY ALL)
SELECT query_id, document_id, page_no, sum(n)::BIGINT AS n_children, max(s) AS score, string_agg(t, chr(10) || chr(10) ORDER BY parent_idx) AS text FROM p GROUP BY query_id, document_id, page_no""")
def expand_parents(spark, d):
    h = hits(spark, d).withColumn("parent_idx", F.col("rank") % 3).withColumn("parent_text", F.expr("concat('P', rank % 3)"))
    return retrieve.expand_parents(h)


@query(f"""WITH {HITS.split("qt AS")[0].strip().rstrip(",")},
u AS (SELECT item_id AS query_id, text, list_distinct(list_filter([trim(text, ' '), trim(text[1:60], ' ')], lambda x: x <> '')) AS vs FROM benchmark),
va AS (SELECT query_id, generate_subscripts(vs, 1) - 1 AS l, unnest(vs) AS v, CASE WHEN len(vs) > 1 THEN 10 ELSE 20 END AS k FROM u),
qt AS (SELECT query_id, l, k, term, count(*) AS times FROM (SELECT query_id, l, k, unnest({TOKENS.format("v")}) AS term FROM va) GROUP BY ALL),
sc AS (SELECT query_id, l, k, chunk_id, round(sum(cast(w * times AS DECIMAL(28,10)))::DOUBLE, 6) AS score FROM post JOIN qt USING (term) GROUP BY ALL),
li AS (SELECT *, row_number() OVER (PARTITION BY query_id, l ORDER BY score DESC, chunk_id) AS r FROM sc WHERE score > 0 QUALIFY r <= k),
m AS (SELECT query_id, count(DISTINCT l) > 1 AS fused FROM li GROUP BY query_id),
f AS (SELECT query_id, chunk_id, fused, CASE WHEN any_value(fused) THEN sum(cast(cast(1 AS DOUBLE) / (r + 60) AS DECIMAL(28,10)))::DOUBLE ELSE any_value(score) END AS score FROM li JOIN m USING (query_id) GROUP BY query_id, chunk_id, fused),
w AS (SELECT query_id, {ASCII.format("text")} AS kws, list_filter(string_split(text, ' '), lambda x: length(x) >= 10) AS names FROM u),
b AS (SELECT query_id, source AS document_id, chunk_id, fused, round(score * (1 + cast(0.25 AS DOUBLE) * len(list_filter(names, lambda x: contains(lower(text), lower(x)))) + least(cast(0.3 AS DOUBLE), cast(0.1 AS DOUBLE) * len(list_filter(kws, lambda x: contains(lower(text), x))))), 8) AS score
 FROM f JOIN documents ON doc_id = chunk_id JOIN w USING (query_id))
SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1)::INT AS rank FROM b""")
def hybrid_retrieve(spark, d):
    """Each question and its beginning ask BM25; words of ten letters stand for names."""
    from docmill.plans import pipelines

    docs = t(spark, d, "documents").select(F.col("source").alias("thread_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id"), "text")
    asked = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.substring("text", 1, 60).alias("start"))
    names = lambda c: F.filter(F.split(c, " "), lambda x: F.length(x) >= 10)
    return pipelines.hybrid_retrieve(docs, asked, ["text", "start"], entities=names, index=stored_index(spark, d))


@query()
def hybrid_retrieve_vectors(spark, d):
    """The same with the default embedder as a second leg, and capitalised phrases as names."""
    from docmill.plans import pipelines

    docs = t(spark, d, "documents").select(F.col("source").alias("thread_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_id"), "text")
    asked = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    fitted = []

    def embed(df, id_col, text_col):
        v, model = retrieve.hashed_embeddings(df, id_col, text_col, 256, *fitted)
        fitted[:] = [model]
        return v

    return pipelines.hybrid_retrieve(docs, asked, embedder=embed, index=stored_index(spark, d))


def _pages(spark, d):
    """Documents in pages of 400 characters behind a blank first page, each in its source's thread and in one
    of all; a third have no type, some are spreadsheets, a fifth have a stored summary."""
    docs = t(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t"))
    each = F.when(F.col("t") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("t", F.lit("(?s).{1,400}"), F.lit(0)))
    slices = F.concat(F.array(F.lit(" \n")), each)
    kind = F.when(F.col("doc_id") % 50 == 7, "spreadsheet").when(F.col("doc_id") % 3 == 0, None).otherwise("text")
    return docs.select(
        F.explode(F.array("source", F.lit("all"))).alias("thread_id"), F.col("doc_id").cast("string").alias("document_id"), kind.alias("type"),
        F.concat(F.lit("Doc "), "doc_id").alias("title"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Stored Summary of "), "doc_id")).alias("summary"), slices.alias("s"),
    ).select("*", F.posexplode("s").alias("p", "text")).select("thread_id", "document_id", "type", "title", "summary", (F.col("p") + 1).alias("page_no"), "text")


PAGE_NAMES = names_sql("pg", "doc_id, page_no", "child")
INDEX = rf"""
src AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents WHERE doc_id % 50 <> 7),
sl AS (SELECT doc_id, i + 2 AS page_no, t[i * 400 + 1:(i + 1) * 400] AS text FROM (SELECT doc_id, t, unnest(range(0, greatest(1, ceil(length(t) / cast(400 AS DOUBLE)))::BIGINT)) AS i FROM src)),
np AS (SELECT doc_id, 1 + count(*) AS pages FROM sl GROUP BY doc_id),
pg AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS child FROM sl WHERE regexp_matches(text, '\S')),
wd AS (SELECT doc_id, page_no, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, page_no, {ASCII.format("text")} AS ws FROM pg)),
wn AS (SELECT doc_id, word, count(*) AS n, min(page_no * 1000000 + pos) AS first FROM wd GROUP BY ALL),
wt AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM wn QUALIFY r <= 8),
topics AS (SELECT doc_id, string_agg(word, ', ' ORDER BY r) AS topics FROM wt GROUP BY doc_id),
hl AS (SELECT doc_id, page_no, list_filter(list_transform(string_split(child, chr(10))[1:5], lambda x: trim(x, ' ')), lambda x: length(x) >= 3 AND length(x) <= 120)[1] AS line FROM pg),
hd AS (SELECT doc_id, page_no, CASE WHEN regexp_matches(line, '(?i)^(\d+[.\)]\s|chapter\s+\d+|section\s+\d+)') THEN line[1:100]
 WHEN upper(line) = line AND lower(line) <> line AND length(line) > 3 AND length(line) < 80 THEN line
 WHEN length(line) < 80 AND NOT regexp_matches(line, '[.,;:!?)"'']$') THEN line ELSE '' END AS heading FROM hl),
st AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no)[1:3000] AS st FROM pg GROUP BY doc_id),
se AS (SELECT doc_id, unnest(ss) AS x, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id, {SENTENCES.format("st")} AS ss FROM st)),
sc AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM se),
sd AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS lead FROM sc WHERE n <= 500 GROUP BY doc_id),
sm AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Stored Summary of ' || doc_id WHEN coalesce(lead, '') = '' THEN st[1:500] ELSE lead END AS summary
  FROM src LEFT JOIN st USING (doc_id) LEFT JOIN sd USING (doc_id)),
sx AS (SELECT doc_id, summary FROM sm WHERE summary IS NOT NULL), {names_sql("sx", "doc_id", "summary", "sn")}, {PAGE_NAMES},
nm AS (SELECT doc_id, page_no, lower(name) AS k, min(i0) AS i0, arg_min(name, i0) AS name FROM names WHERE lower(name) NOT IN ({STOPS}) GROUP BY ALL),
en AS (SELECT doc_id, page_no, list(name ORDER BY i0)[1:15] AS entities FROM nm GROUP BY ALL),
sk AS (SELECT doc_id, lower(name) AS k, min(i0) AS i0, arg_min(name, i0) AS name FROM sn WHERE lower(name) NOT IN ({STOPS}) GROUP BY ALL),
es AS (SELECT doc_id, list(name ORDER BY i0)[1:15] AS entities FROM sk GROUP BY ALL),
cx AS (SELECT *, strpos(lower(child), k) AS loc FROM nm JOIN pg USING (doc_id, page_no)),
cy AS (SELECT *, trim(substring(child, greatest(1, loc - 60), length(name) + 60 + least(60, loc - 1)), ' ') AS context, row_number() OVER (PARTITION BY doc_id, k ORDER BY page_no, loc) AS r FROM cx),
pf AS (SELECT doc_id, k, count(*) AS n, min(page_no) AS p0, arg_min(loc, page_no) AS at0, arg_min(name, page_no) AS name, string_agg(page_no::VARCHAR, ', ' ORDER BY page_no) AS on_pages,
  string_agg(context, ' ... ' ORDER BY r) FILTER (r <= 3) AS contexts FROM cy GROUP BY doc_id, k),
pt AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p0, at0, name, k) AS r FROM pf QUALIFY r <= 10),
rows_ AS (
SELECT doc_id, page_no, 'child' AS chunk_type, 0 AS chunk_index, doc_id || '_page' || page_no || '_p0_c0' AS chunk_id, doc_id || '_page' || page_no || '_p0' AS parent_chunk_id, child AS parent_text,
  coalesce(array_to_string(entities, '|'), '') AS entities,
  concat_ws(chr(10), 'Document: Doc ' || doc_id, 'Page: ' || page_no || '/' || pages, CASE WHEN heading <> '' THEN 'Section: ' || heading END, CASE WHEN topics <> '' THEN 'Topics: ' || topics END) || chr(10) || chr(10) || child AS text
 FROM pg JOIN np USING (doc_id) JOIN hd USING (doc_id, page_no) LEFT JOIN topics USING (doc_id) LEFT JOIN en USING (doc_id, page_no)
UNION ALL SELECT doc_id, 0, 'document_summary', -1, doc_id || '_summary', NULL, NULL, coalesce(array_to_string(entities, '|'), ''),
  'Document: Doc ' || doc_id || ' | Summary' || chr(10) || 'Topics: ' || coalesce(topics, '') || chr(10) || chr(10) || summary FROM sx LEFT JOIN topics USING (doc_id) LEFT JOIN es USING (doc_id)
UNION ALL SELECT doc_id, 0, 'entity_profile', -2, doc_id || '_entity_' || regexp_replace(lower(name), '[^a-z0-9_]', '_', 'g'), NULL, NULL, name,
  'Entity Profile: ' || name || ' | Document: Doc ' || doc_id || chr(10) || 'Mentioned on pages: ' || on_pages || chr(10) || 'Contexts: ' || contexts FROM pt WHERE n >= 2)"""
INDEX_ROWS = """SELECT thread_id, doc_id::VARCHAR AS document_id, page_no::INT AS page_no, chunk_type, chunk_index::INT AS chunk_index, chunk_id, parent_chunk_id, parent_text, entities, text
 FROM rows_ JOIN (SELECT doc_id, source AS thread_id FROM documents UNION ALL SELECT doc_id, 'all' FROM documents) USING (doc_id)"""


def _index_rows(index):
    return index.select("thread_id", "document_id", "page_no", "chunk_type", "chunk_index", "chunk_id", "parent_chunk_id", "parent_text", F.array_join("entities", "|").alias("entities"), "text")


@query(f"WITH {INDEX} {INDEX_ROWS}")
def build_chunk_index(spark, d):
    from docmill.plans import pipelines

    return _index_rows(pipelines.build_chunk_index(_pages(spark, d)))


@query(f"""WITH {INDEX}, r AS ({INDEX_ROWS})
SELECT thread_id, document_id, count(DISTINCT page_no) FILTER (page_no > 0) AS n_pages, count(*) FILTER (chunk_type = 'child') AS n_children, count(*) FILTER (chunk_type = 'entity_profile') AS n_profiles,
 count(*) FILTER (chunk_type = 'document_summary') > 0 AS has_summary, string_agg(chunk_id, ' ' ORDER BY chunk_id) AS chunk_ids FROM r GROUP BY ALL""")
def document_manifest(spark, d):
    from docmill.plans import pipelines

    return pipelines.document_manifest(pipelines.build_chunk_index(_pages(spark, d))).withColumn("chunk_ids", F.array_join("chunk_ids", " "))


@query(f"""
WITH sl AS (SELECT source, doc_id, i AS part, t[i * 400 + 1:(i + 1) * 400] AS text FROM (SELECT source, doc_id, t, unnest(range(0, ceil(length(t) / cast(400 AS DOUBLE))::BIGINT)) AS i FROM (SELECT source, doc_id, coalesce(text, '') AS t FROM documents))),
{names_sql("sl", "source, doc_id, part")},
nm AS (SELECT source, doc_id, part, lower(name) AS k, min(i0) AS i0, arg_min(name, i0) AS name FROM names WHERE lower(name) NOT IN ({STOPS}) GROUP BY ALL),
cx AS (SELECT nm.*, text, strpos(lower(text), k) AS loc FROM nm JOIN sl ON nm.source = sl.source AND nm.doc_id = sl.doc_id AND nm.part = sl.part),
cy AS (SELECT *, trim(substring(text, greatest(1, loc - 60), length(name) + 60 + least(60, loc - 1)), ' ') AS context, row_number() OVER (PARTITION BY source, k ORDER BY doc_id, part, loc) AS r FROM cx),
pf AS (SELECT source, k, count(DISTINCT doc_id) AS n_pages, min((doc_id, part, loc)) AS first, arg_min(name, (doc_id, part, loc)) AS name, string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS pages,
  string_agg(context, ' ... ' ORDER BY r) FILTER (r <= 3) AS contexts FROM cy GROUP BY source, k),
pt AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_pages DESC, first, name, k) AS r FROM pf QUALIFY r <= 10)
SELECT source, name, n_pages, pages, contexts FROM pt WHERE n_pages >= 2""")
def entity_profiles(spark, d):
    """Sources as documents, documents as their pages, 400 characters as a chunk."""
    docs = t(spark, d, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("t")).where("t <> ''")
    n = F.ceil(F.length("t") / 400).cast("int")
    chunk = docs.select("source", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("t"), i * 400 + 1, F.lit(400)))).alias("part", "text"))
    out = enrich.entity_profiles(enrich.chunk_mentions(chunk, "text"), "source", "doc_id", "name", "text", chunk_col="part")
    pages = F.array_join(F.array_sort(F.transform("pages", lambda x: x.cast("string"))), ",")
    return out.select("source", "name", "n_pages", pages.alias("pages"), F.array_join("contexts", " ... ").alias("contexts"))


@query("""SELECT doc_id, source AS subject, 'writes' AS predicate, lang AS object FROM documents WHERE doc_id % 2 = 1""")
def store_triples(spark, d):
    new = t(spark, d, "documents").select("doc_id", F.col("source").alias("subject"), F.lit("writes").alias("predicate"), F.col("lang").alias("object"), F.col("n_chars").alias("page_no"))
    return enrich.store_triples(new.where("doc_id % 2 = 0"), new.union(new), ["page_no"], "doc_id").select("doc_id", "subject", "predicate", "object")


TRIPLES = """tr AS (SELECT DISTINCT source AS subject, 'writes' AS predicate, lang AS object FROM documents),
hit AS (SELECT n_nationkey AS query_id, tr.*, row_number() OVER (PARTITION BY n_nationkey ORDER BY subject, object) AS r FROM tr, nation WHERE contains(lower(subject), 'src' || n_nationkey)),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM hit WHERE r <= 20 QUALIFY rank <= 20)"""


def _triple_hits(spark, d):
    tr = t(spark, d, "documents").select(F.col("source").alias("subject"), F.lit("writes").alias("predicate"), F.col("lang").alias("object")).distinct()
    asked = t(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.lit(0).alias("pos"), F.expr("concat('SRC', n_nationkey)").alias("entity"))
    return enrich.triples_for_entities(tr, asked, ["subject", "object"])


@query(f"WITH {TRIPLES} SELECT query_id, rank::INT AS rank, subject, predicate, object FROM f")
def triples_for_entities(spark, d):
    return _triple_hits(spark, d)


@query(f"WITH {TRIPLES} SELECT query_id, 'Entity Relationships:' || chr(10) || string_agg('- ' || subject || ' ' || predicate || ' ' || object, chr(10) ORDER BY rank) AS context FROM f GROUP BY query_id")
def triple_context(spark, d):
    return enrich.triple_context(_triple_hits(spark, d))


@query("SELECT 'n' || c_nationkey AS sheet_id, 1 AS header_row, 1.0::DOUBLE AS score, 'Report' AS context FROM customer GROUP BY c_nationkey")
def detect_header(spark, d):
    c = t(spark, d, "customer")
    sheet = F.expr("concat('n', c_nationkey)")
    top = c.select(sheet.alias("sheet_id")).distinct()
    grid = top.select("sheet_id", F.lit(0).alias("row"), F.array(F.lit("Report"), F.lit(""), F.lit("")).alias("cells"))
    grid = grid.union(top.select("sheet_id", F.lit(1), F.array(F.lit("key"), F.lit("name"), F.lit("segment"))))
    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) + 1
    return tables.detect_header(grid.union(c.select(sheet, r, F.array(F.col("c_custkey").cast("string"), F.col("c_custkey").cast("string"), "c_mktsegment"))))


@query("SELECT doc_id, 1::BIGINT AS n_tables, 'doc | lang' AS columns, doc_id || ' | ' || lang || chr(10) || 'more | ' AS preview, true AS has_tables FROM documents")
def table_catalog(spark, d):
    docs = t(spark, d, "documents")
    body = F.expr("concat(translate(text, '|[', ''), '\\n\\n| doc | lang |\\n|---|---|\\n| ', doc_id, ' | ', lang, ' |\\n\\n| more |\\nend')")
    return tables.table_catalog(docs, tables.extract_tables(docs.withColumn("text", body), "doc_id", "text"), "doc_id")


@query("SELECT doc_id::VARCHAR AS id, 1 AS page_no, text FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 10 <> 1")
def read_parsed_documents(spark, d):
    """Of ten lines one is cut short and one has no id."""
    page = F.array(F.struct(F.lit(1).alias("number"), "text"))
    named = F.when(F.col("doc_id") % 10 != 1, F.col("doc_id").cast("string")).alias("id")
    line = t(spark, d, "documents").select("doc_id", F.to_json(F.struct(named, F.col("source").alias("title"), page.alias("content"))).alias("j"))
    path = readers.scratch(spark, "parsed")
    line.select(F.when(F.col("doc_id") % 10 == 0, F.expr("substring(j, 1, length(j) - 5)")).otherwise(F.col("j"))).write.text(path)
    return readers.read_parsed_documents(spark, path, False).select("id", "page_no", "text")


@query("SELECT c_custkey AS customer_key, c_name AS name, c_acctbal AS balance_2024, c_mktsegment AS name_2 FROM customer")
def read_spreadsheet_csv(spark, d):
    path = readers.scratch(spark, "sheet")
    named = {"c_custkey": "Customer Key", "c_name": "name", "c_acctbal": "Balance (2024)", "c_mktsegment": "NAME!"}
    t(spark, d, "customer").select(*[F.col(c).alias(n) for c, n in named.items()]).write.option("header", True).csv(path)
    return readers.read_spreadsheet_csv(spark, path)


@query()
def file_inventory(spark, d):
    files = readers.file_inventory(spark, d)
    return files.groupBy("extension", "class").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))


@query(f"""WITH {INDEX}, r AS ({INDEX_ROWS}),
tok AS (SELECT thread_id AS thread, chunk_id, unnest({TOKENS.format("text")}) AS term FROM r), tf AS (SELECT thread, chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
sizes AS (SELECT thread, chunk_id, sum(tf) AS dl FROM tf GROUP BY ALL), nn AS (SELECT thread_id AS thread, count(*) AS n FROM r GROUP BY ALL),
av AS (SELECT thread, sum(dl)::DOUBLE / any_value(n) AS avgdl FROM sizes JOIN nn USING (thread) GROUP BY thread),
i0 AS (SELECT thread, term, ln(any_value(n) - count(*) + cast(0.5 AS DOUBLE)) - ln(count(*) + cast(0.5 AS DOUBLE)) AS idf FROM tf JOIN nn USING (thread) GROUP BY thread, term),
me AS (SELECT thread, sum(cast(idf AS DECIMAL(38,10)))::DOUBLE / count(*) AS mean FROM i0 GROUP BY thread),
i1 AS (SELECT thread, term, CASE WHEN idf < 0 THEN cast(0.25 AS DOUBLE) * mean ELSE idf END AS idf FROM i0 JOIN me USING (thread)),
p AS (SELECT thread, term, chunk_id, idf * tf * cast(2.5 AS DOUBLE) / (tf + cast(1.5 AS DOUBLE) * (cast(0.25 AS DOUBLE) + cast(0.75 AS DOUBLE) * dl / avgdl)) AS w
 FROM tf JOIN sizes USING (thread, chunk_id) JOIN av USING (thread) JOIN i1 USING (thread, term))
SELECT thread, term, count(*) AS n, round(sum(cast(w AS DECIMAL(28,10)))::DOUBLE, 4) AS total FROM p GROUP BY ALL""")
def reindex_corpus(spark, d):
    """The postings of a rebuilt index, by thread and term."""
    from docmill.plans import pipelines

    postings = pipelines.reindex_corpus(_pages(spark, d), readers.scratch(spark, "index"))[1]
    return postings.groupBy("thread", "term").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("weight").cast("decimal(28,10)")).cast("double"), 4).alias("total"))


@query(f"""WITH {HITS}, o AS (SELECT item_id AS id, 'src' || (item_id % 20) AS thread FROM benchmark),
b AS (SELECT *, (row_number() OVER (PARTITION BY thread ORDER BY id) - 1) // 4 AS batch FROM o)
SELECT id, batch::BIGINT AS batch, chunk_id, rank::INT AS rank, score FROM top JOIN b ON b.id = query_id AND b.thread = top.thread WHERE score > 0""")
def node_sources(spark, d):
    from docmill.plans import pipelines

    nodes = t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.expr("concat('src', item_id % 20)").alias("thread_id"), F.col("text").alias("title"))
    return pipelines.node_sources(nodes, stored_index(spark, d), 5)


@query("SELECT c_custkey AS sheet_id, c_mktsegment || '_' || c_name || '|Column_1|Column_2|' || c_nationkey AS names FROM customer")
def flatten_headers(spark, d):
    upper = F.array("c_mktsegment", F.lit(""), F.lit("nan"), F.lit(None).cast("string"))
    lower = F.array("c_name", F.lit(" "), F.lit("Unnamed: 0_level_1"), F.col("c_nationkey").cast("string"))
    pairs = t(spark, d, "customer").select(F.col("c_custkey").alias("sheet_id"), upper.alias("upper"), lower.alias("lower"))
    return tables.flatten_headers(pairs).withColumn("names", F.array_join("names", "|"))


@query("""SELECT c_mktsegment AS name, count(*) AS n, false AS truncated, 'customer_list_csv_c1 suppliers_xlsx_all_s1' AS tables FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'suppliers', count(*), false, 'customer_list_csv_c1 suppliers_xlsx_all_s1' FROM supplier""")
def register_tables(spark, d):
    """Sheets are registered, one is dropped; another session loads only what is missing from its file and asks the tables."""
    from docmill.sources.registry import Registry

    base = readers.scratch(spark, "registry")
    made = Registry(spark, base)
    made.register({("c1", "Customer list.csv", None): t(spark, d, "customer").where("c_custkey > 5"), ("n1", "Nations.csv", None): t(spark, d, "nation")})
    made.register({("c1", "Customer list.csv", None): t(spark, d, "customer")})
    made.drop(spark.createDataFrame([("n1",)], "doc_id string"))
    t(spark, d, "supplier").write.option("header", True).csv(f"{base}/suppliers")
    other = spark.newSession()
    known = Registry(other, base)
    known.reload_from_files(other.createDataFrame([("c1", "Customer list.csv", "gone"), ("s1", "Suppliers.xlsx All", f"{base}/suppliers")], "doc_id string, file string, path string"))
    names = " ".join(known.open())
    rows, _, truncated, error = tables.guarded_select(other, "SELECT c_mktsegment AS name, count(*) AS n FROM customer_list_csv_c1 GROUP BY c_mktsegment UNION ALL SELECT 'suppliers', count(*) FROM suppliers_xlsx_all_s1")
    if error:
        raise ValueError(error)
    return rows.withColumns({"truncated": F.lit(truncated), "tables": F.lit(names)})


def _sheets(spark, d):
    """A sheet a nation: a seventh of the rows and the third column are blank, two columns have no name."""
    c = t(spark, d, "customer")
    some = lambda x: F.when(F.col("c_custkey") % 7 != 0, F.col(x))
    columns = {"key": some("c_custkey"), "name": some("c_name"), "nothing": F.lit(" "), "Unnamed: 3": some("c_mktsegment"), "Unnamed: 4": some("c_acctbal")}
    return sheets.repair_sheets(sheets.sheet_grid(c, F.concat(F.lit("n"), "c_nationkey"), F.col("c_custkey"), columns))


SHEETS = """c AS (SELECT *, 'n' || c_nationkey AS sheet_id, first(c_mktsegment) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS seg FROM customer WHERE c_custkey % 7 <> 0),
g AS (SELECT sheet_id, c_custkey::BIGINT AS row, unnest([0, 1, 3, 4]) AS col, unnest(['key', 'name', seg, 'Column_4']) AS name, unnest([c_custkey::VARCHAR, c_name, c_mktsegment, c_acctbal::VARCHAR]) AS value FROM c),
h AS (SELECT sheet_id, any_value(seg) AS seg, count(*) AS n FROM c GROUP BY sheet_id)"""


@query(f"WITH {SHEETS} SELECT sheet_id, row, col::INT AS col, name, value FROM g")
def repair_sheets(spark, d):
    return _sheets(spark, d)


@query(f"WITH {SHEETS} SELECT sheet_id, col::INT AS col, name, CASE col WHEN 0 THEN 'bigint' WHEN 4 THEN 'double' ELSE 'string' END AS type, count(*) AS n FROM g GROUP BY ALL")
def sheet_types(spark, d):
    return sheets.sheet_types(_sheets(spark, d))


@query(f"""WITH {SHEETS}, s AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY c_custkey) AS r FROM c QUALIFY r <= 3)
SELECT sheet_id, 'key (bigint), name (string), ' || seg || ' (string), Column_4 (double)' AS columns, n AS n_rows,
 (SELECT string_agg('key: ' || c_custkey || ' | name: ' || c_name || ' | ' || s.seg || ': ' || c_mktsegment || ' | Column_4: ' || c_acctbal, chr(10) ORDER BY r) FROM s WHERE s.sheet_id = h.sheet_id) AS sample FROM h""")
def describe_sheets(spark, d):
    return sheets.describe_sheets(_sheets(spark, d))


@query(f"""WITH {SHEETS}, b AS (SELECT *, dense_rank() OVER (PARTITION BY sheet_id ORDER BY c_custkey // 200) - 1 AS block FROM c),
x AS (SELECT sheet_id, block, string_agg('| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' | ' || c_acctbal || ' |', chr(10) ORDER BY c_custkey) AS t FROM b GROUP BY ALL)
SELECT sheet_id, block::INT AS block, CASE WHEN block = 0 THEN concat_ws(chr(10), 'Sheet: ' || sheet_id, 'Columns: key, name, ' || seg || ', Column_4', 'Rows: ' || n, '', '| key | name | ' || seg || ' | Column_4 |', '| --- | --- | --- | --- |', t) ELSE t END AS text
FROM x JOIN h USING (sheet_id)""")
def sheets_text(spark, d):
    return sheets.sheets_text(_sheets(spark, d), 200)


@query(f"""WITH {SHEETS} SELECT sheet_id, unnest(['Rows', 'key sum', 'key mean', 'Column_4 sum', 'Column_4 mean']) AS metric,
 unnest([count(*)::DOUBLE, sum(c_custkey)::DOUBLE, round(sum(c_custkey)::DOUBLE / count(*), 6), sum(cast(c_acctbal AS DECIMAL(28,10)))::DOUBLE, round(sum(cast(c_acctbal AS DECIMAL(28,10)))::DOUBLE / count(*), 6)]) AS value FROM c GROUP BY sheet_id""")
def sheets_metrics(spark, d):
    return sheets.sheets_metrics(_sheets(spark, d))


@query("SELECT 'sql' AS how, p_partkey, p_size FROM part WHERE p_size > 45 UNION ALL SELECT 'sql', p_partkey, p_size FROM part WHERE p_size = 7 UNION ALL SELECT 'extract', p_partkey, p_size FROM part WHERE p_size <= 5 UNION ALL SELECT 'document', p_partkey, p_size FROM part WHERE p_size > 40")
def resolve_sheet_source(spark, d):
    part = t(spark, d, "part").select("p_partkey", "p_size")
    """SQL rows with the filter, SQL that filters by itself, a named table, the first with rows, none."""
    part.createOrReplaceTempView("parts_of_a_sheet")
    ask = lambda *a, **k: (lambda how, rows: rows.selectExpr(f"'{how}' AS how", "cast(p_partkey AS bigint) AS p_partkey", "cast(p_size AS int) AS p_size"))(*tables.resolve_sheet_source(spark, part.columns, *a, **k))
    none, docs = part.where("p_size < 0"), {"Other": part.where("p_size < 0"), "Parts A": part.where("p_size > 40"), "Parts B": part.where("p_size <= 5")}
    cases = [
        ask("SELECT * FROM parts_of_a_sheet", "p_size > 45"), ask("SELECT * FROM parts_of_a_sheet WHERE p_size = 7", "p_size > 45"),
        ask("SELECT * FROM parts_of_a_sheet WHERE p_size < 0", doc_tables=docs, sources=("x", "extract:parts b")), ask(doc_tables=docs), ask(doc_tables={"Other": none}),
    ]
    return reduce(DataFrame.unionByName, cases)


@query("SELECT conv_id, coalesce(string_agg(text, '|' ORDER BY turn) FILTER (turn % 2 = 0), '') AS texts FROM conversations GROUP BY conv_id")
def selected_instructions(spark, d):
    own = F.array_sort(F.collect_list(F.struct("turn", (F.col("turn") % 2 == 0).alias("selected"), "text")))
    threads = t(spark, d, "conversations").groupBy("conv_id").agg(own.alias("instructions"))
    return chat.selected_instructions(threads, "conv_id", "instructions").withColumn("texts", F.array_join("texts", "|"))


@query("SELECT 'f' || o_orderkey || '.xlsx' AS file_name, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0")
def list_exports(spark, d):
    name, o = F.expr("concat('f', o_orderkey, '.xlsx')").alias("file_name"), t(spark, d, "orders")
    records = o.select(name, F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") != "F", "pending").alias("_status"))
    return chat.list_exports(records, o.where("o_orderkey % 3 = 0").select(name)).select("file_name", "created_at")


STATUS = """e AS (SELECT user_id, ts, CASE WHEN event_type = 'click' THEN 'pending' ELSE event_type END AS s FROM events),
last AS (SELECT user_id, max(ts) AS ts, arg_max(s, (ts, s)) AS s FROM e GROUP BY user_id),
now AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 MINUTE AS w FROM e),
j AS (SELECT user_id, date_trunc('milliseconds', ts) AS ts, s, s = 'pending' AND date_trunc('milliseconds', ts) + INTERVAL 8 MINUTE <= w AS late, w FROM last, now)"""


def _status_run(spark, d, keep_s):
    """Run the stream of all events; the folder that holds its rows and state."""
    base = readers.scratch(spark, "status")
    arriving = spark.readStream.schema(t(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    arriving = arriving.select("user_id", "ts", F.when(F.col("event_type") == "click", "pending").otherwise(F.col("event_type")).alias("s"))
    out = status.status_stream(arriving, "user_id", "ts", "s", keep_s=keep_s)
    save = lambda b, epoch: b.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/rows/epoch={epoch:09d}")
    run = out.writeStream.outputMode("update").foreachBatch(lambda b, e: save(b, e)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return base


@query(f"WITH {STATUS} SELECT user_id, CASE WHEN late THEN 'failed' ELSE s END AS status, CASE WHEN late THEN 'generation timed out' END AS message FROM j")
def status_stream(spark, d):
    """Each job's last state after the whole stream, as emitted."""
    rows = spark.read.parquet(f"{_status_run(spark, d, 24 * 3600)}/rows/*")
    last = rows.groupBy("id").agg(F.max_by(F.struct("status", "message"), "epoch").alias("m"))
    return last.select(F.col("id").alias("user_id"), "m.status", "m.message")


@query(f"WITH {STATUS} SELECT user_id, ts AS at, CASE WHEN late THEN 'failed' ELSE s END AS status FROM j WHERE late OR s = 'pending' OR ts + INTERVAL 1 HOUR > w")
def status_state(spark, d):
    """The state that the stream leaves: jobs finished over an hour ago are forgotten."""
    return status.left_state(spark, f"{_status_run(spark, d, 3600)}/state").withColumnRenamed("id", "user_id")


@query(f"WITH {INDEX} {INDEX_ROWS}")
def ingest_stream(spark, d):
    """The index after the pages arrived in three batches: odd pages with another text and the first
    pages, then even pages, then the odd ones as they are now. It equals the index of all pages at once."""
    base = readers.scratch(spark, "ingest")
    pages = _pages(spark, d)
    odd = (F.col("page_no") % 2 == 1) & (F.col("page_no") > 1)
    old = pages.where("page_no = 1 OR page_no % 2 = 1").withColumn("text", F.when(odd, F.concat(F.lit("Old Words. "), "text")).otherwise(F.col("text")))
    schema = pages.withColumn("arrived", F.lit(0)).schema
    for k, part in enumerate((old, pages.where("page_no % 2 = 0"), pages.where(odd))):
        part.withColumn("arrived", F.lit(k)).write.parquet(f"{base}/in/{k}")
        arriving = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/in")
        status.ingest_stream(arriving, f"{base}/index", f"{base}/state", "arrived", 4).awaitTermination()
    return _index_rows(status.current_index(spark, f"{base}/index"))
