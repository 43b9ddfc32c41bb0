"""A registry of spreadsheet tables that outlives the session: tables as folders, one versioned list of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.tables import table_name
from docmill.sources.readers import read_spreadsheet_csv
from docmill.sources.versions import Versions

ROW = "doc_id string, table_name string, path string"


class Registry:
    """Tables of documents under ``base``. A table is written before the list that names it is published, so
    a job that ends between leaves the registry as it was."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.store = spark, Versions(spark, f"{base.rstrip('/')}/registry")
        self.base = base.rstrip("/")

    def rows(self) -> DataFrame:
        """(doc_id, table_name, path) of all registered tables."""
        held = self.store.read("tables")
        return self.spark.createDataFrame([], ROW) if held is None else held.drop("part").select("doc_id", "table_name", "path")

    def _publish(self, rows: DataFrame) -> None:
        version = (self.store.versions() or [-1])[-1] + 1
        self.store.switch(version, {"tables": self.store.write("tables", rows.coalesce(1).withColumn("part", F.lit(0)), version)})
        self.store.clean()

    def register(self, sheets: dict[tuple[str, str, str | None], DataFrame]) -> list[str]:
        """Write the sheets of (doc_id, file, sheet) and name them; a table of the same name is replaced."""
        version, made = (self.store.versions() or [-1])[-1] + 1, []
        for (doc_id, file, sheet), df in sheets.items():
            name = table_name(file, doc_id, sheet)
            path = f"{self.base}/data/{name}/v{version}"
            df.write.mode("overwrite").parquet(path)
            made.append((doc_id, name, path))
        new = self.spark.createDataFrame(made, ROW)
        self._publish(self.rows().join(new.select("table_name"), "table_name", "left_anti").select("doc_id", "table_name", "path").unionByName(new))
        return [name for _, name, _ in made]

    def missing(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` documents (doc_id, ...) that have no table."""
        return wanted.join(self.rows(), "doc_id", "left_anti")

    def reload_from_files(self, files: DataFrame) -> list[str]:
        """Load the CSV files (doc_id, file, path) of the documents that have no table, and of no others."""
        rest = self.missing(files).orderBy("doc_id", "file").collect()  # the list of files, not their content
        return self.register({(r["doc_id"], r["file"], None): read_spreadsheet_csv(self.spark, r["path"]) for r in rest}) if rest else []

    def open(self, wanted: DataFrame | None = None) -> list[str]:
        """Views of the tables (of the ``wanted`` documents) in this session."""
        rows = self.rows() if wanted is None else self.rows().join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        names = []
        for r in rows.orderBy("table_name").collect():
            self.spark.read.parquet(r["path"]).createOrReplaceTempView(r["table_name"])
            names.append(r["table_name"])
        return names

    def drop(self, deletes: DataFrame) -> None:
        """Take the documents' tables out of the registry and remove their files."""
        gone = self.rows().join(deletes.select("doc_id").distinct(), "doc_id", "left_semi").collect()
        self._publish(self.rows().join(deletes.select("doc_id").distinct(), "doc_id", "left_anti"))
        for r in gone:
            self.spark.catalog.dropTempView(r["table_name"])
            self.store.fs.delete(self.store._path(f"{self.base}/data/{r['table_name']}"), True)
