"""Versioned tables in a folder: parts written under a version, one manifest that says which version
of each part counts, and the removal of what no manifest needs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Tables under ``base``, each dealt into numbered parts (a column ``part``).

    ``write`` puts new parts beside the old ones; nothing reads them until ``switch`` publishes a
    manifest that names them. The manifest is written under another name and renamed, so readers see
    the old version or the new one, whenever a job ends. ``clean`` keeps the last two
    manifests, which lets readers of the last but one finish, and removes every other folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        where = self._path(path)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        return sorted(int(n) for n in self._names(f"{self.base}/manifests") if n.isdigit())

    def manifest(self, version: int | None = None) -> dict[str, dict[int, int]]:
        """{table: {part: version}} of a published version, by default the newest; empty if there is none."""
        known = self.versions()
        if version is None and not known:
            return {}
        stream = self.fs.open(self._path(f"{self.base}/manifests/{known[-1] if version is None else version}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {table: {int(p): v for p, v in parts.items()} for table, parts in json.loads(text).items()}

    def read(self, table: str, parts=None, version: int | None = None) -> DataFrame | None:
        """The current rows of ``table`` (of some ``parts``), with the column ``part``; None if it has none."""
        held = self.manifest(version).get(table, {})
        paths = [f"{self.base}/{table}/version={v}/part={p}" for p, v in sorted(held.items()) if parts is None or p in parts]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.base}/{table}").parquet(*paths).drop("version")

    def write(self, table: str, rows: DataFrame, version: int) -> dict[int, int]:
        """Write ``rows`` (with ``part``) as a version of its parts: {part: version} of those that hold rows.
        What an ended attempt has left of the version is replaced."""
        path = f"{self.base}/{table}/version={version}"
        rows.write.mode("overwrite").partitionBy("part").parquet(path)
        return {int(n.removeprefix("part=")): version for n in self._names(path) if n.startswith("part=")}

    def switch(self, version: int, manifest: dict[str, dict[int, int]]) -> None:
        """Publish ``manifest`` as ``version``."""
        part = self._path(f"{self.base}/manifests/.{version}.part")
        out = self.fs.create(part, True)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        if not self.fs.rename(part, self._path(f"{self.base}/manifests/{version}")):
            raise OSError(f"version {version} is published already")

    def clean(self, keep: int = 2) -> None:
        """Remove manifests before the last ``keep`` and folders that the kept ones don't name. A version
        that is newer than every manifest is still being written and stays."""
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        for v in known[:-keep]:
            self.fs.delete(self._path(f"{self.base}/manifests/{v}"), False)
        for table in [n for n in self._names(self.base) if n != "manifests"]:
            named = {(v, p) for m in kept for p, v in m.get(table, {}).items()}
            for folder in self._names(f"{self.base}/{table}"):
                version = int(folder.removeprefix("version="))
                if known and version > known[-1]:
                    continue
                parts = [int(n.removeprefix("part=")) for n in self._names(f"{self.base}/{table}/{folder}") if n.startswith("part=")]
                if not any((version, p) in named for p in parts):
                    self.fs.delete(self._path(f"{self.base}/{table}/{folder}"), True)
                    continue
                for p in parts:
                    if (version, p) not in named:
                        self.fs.delete(self._path(f"{self.base}/{table}/{folder}/part={p}"), True)
