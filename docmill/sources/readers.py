"""Reading parsed documents, sheets, pages and folders; writing and keeping chunk indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.scratch import scratch  # noqa: F401
from docmill.operators.retrieve import bm25_index
from docmill.operators.tables import infer_types, sanitize_names
from docmill.operators.text import clean_cells

DOCUMENT = (
    "id string, type string, file_name string, title string, full_text string, summary string,"
    " content array<struct<number int, text string, images array<string>>>, _bad string"
)
#: Extensions by class.
EXTENSIONS = {
    "image": ["png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff"],
    "spreadsheet": ["xls", "xlsx", "csv"],
    "text": ["pdf", "doc", "docx", "ppt", "pptx", "txt", "md", "html"],
}


def read_parsed_documents(spark: SparkSession, path: str, one_a_file: bool = True) -> DataFrame:
    """One row a page of JSON documents, one a file or one a line; corrupt ones and those without
    an id are skipped."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", one_a_file).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = docs.where("_bad is null and id is not null").drop("_bad")
    pages = good.select("*", F.posexplode_outer("content").alias("pos", "page")).drop("content")
    return pages.select(*[c for c in good.columns if c != "content"], F.coalesce("page.number", F.col("pos") + 1).alias("page_no"), F.col("page.text").alias("text"))


def read_spreadsheet_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet with clean cells, safe column names and the narrowest types."""
    raw = clean_cells(spark.read.option("header", True).option("inferSchema", False).csv(path))
    head = spark.read.csv(path).first()  # Spark numbers repeated names of a header; the row itself has them
    named = sanitize_names(spark.createDataFrame([("s", i, c or "") for i, c in enumerate(head or raw.columns)], "sheet_id string, pos int, name string"))
    return infer_types(raw.toDF(*[r["clean"] for r in named.orderBy("pos").collect()]))


def page_text(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, title, text): markup to plain lines, natively."""
    c = F.coalesce(html_col, F.lit(""))
    c = F.regexp_replace(c, r"(?is)<(script|style|head)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?i)</?(p|div|br|h[1-6]|li|ul|ol|table|tr|article|section|nav|footer|header)\b[^>]*>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" ?\n[ \n]*", "\n")
    title = F.regexp_extract(F.coalesce(html_col, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return df.select(id_col, title.alias("title"), F.regexp_replace(c, r"^\s+|\s+$", "").alias("text"))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, extension, class); class is null for what is skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    known = spark.createDataFrame([(x, k) for k, v in EXTENSIONS.items() for x in v], "extension string, class string")
    ext = files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    return ext.join(F.broadcast(known), "extension", "left")


def upsert_chunks(stored: DataFrame, new: DataFrame, key: str = "chunk_id", owner: str | None = None) -> DataFrame:
    """Both tables with one row a chunk id: the newer one, and of several new rows the least in all
    columns. With ``owner`` the stored chunks of every owner in ``new`` go first, so a document
    that was sent again leaves no stale chunks."""
    if owner:
        stored = stored.join(new.select(owner).distinct(), owner, "left_anti").select(*stored.columns)
    both = stored.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_v"), *[F.asc(c) for c in stored.columns if c != key])
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_v", "_r")


def delete_documents(rows: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (chunks, triples, tables) without those of the deleted documents."""
    return rows.join(deletes.select(*keys).distinct(), keys, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], deletes: DataFrame, thread_col: str = "thread_id", doc_col: str = "document_id") -> dict[str, DataFrame]:
    """All ``tables`` of an index (chunks, triples, tables and so on) without the deleted documents
    (thread, document). A table without threads keeps a document that the ``chunks`` of another
    thread still hold. Where there are ``postings`` and ``chunks`` (chunk_id, text), BM25 is weighed
    anew for the threads that lost a document, and only for those."""
    gone = deletes.select(thread_col, doc_col).distinct()
    left = {name: delete_documents(df, gone, [thread_col, doc_col]) for name, df in tables.items() if name != "postings" and thread_col in df.columns}
    lost = gone.select(doc_col).distinct()
    if "chunks" in left:
        lost = lost.join(left["chunks"].select(doc_col).distinct(), doc_col, "left_anti")
    left |= {name: delete_documents(df, lost, [doc_col]) for name, df in tables.items() if name != "postings" and thread_col not in df.columns}
    if "postings" in tables:
        touched = gone.select(F.col(thread_col).alias("thread")).distinct()
        rest = tables["postings"].join(touched, "thread", "left_anti")
        again = left["chunks"].join(touched.withColumnRenamed("thread", thread_col), thread_col, "left_semi")
        left["postings"] = rest.unionByName(bm25_index(again, thread_col, "chunk_id", "text"))
    return left


def copy_documents(chunks: DataFrame, copies: DataFrame) -> DataFrame:
    """``chunks`` and copies of documents (src, dst, document_id) under ids of the other thread;
    copies into the same thread, and of documents that it has, are refused."""
    have = chunks.select(F.col("thread_id").alias("dst"), "document_id").distinct()
    ok = copies.where("src <> dst").distinct().join(have, ["dst", "document_id"], "left_anti")
    new = chunks.join(ok.withColumnsRenamed({"src": "thread_id"}), ["thread_id", "document_id"])
    new = new.withColumn("chunk_id", F.concat_ws("_", "dst", "chunk_id")).withColumn("thread_id", F.col("dst")).select(*chunks.columns)
    return chunks.unionByName(new)
