"""A stored graph: generations of Parquet tables and a manifest that names the current one."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigCorrupt, IndexNotReady, SchemaVersionMismatch, StaleIndex
from ..graph import EDGES, FILES, SYMBOLS, Graph
from ..operators.catalog import change_set

SCHEMA_VERSION = 5


class Store:
    """Graphs under one folder of any file system that Spark reaches. A build is visible once its manifest is renamed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self._conf), path

    def _write(self, name: str, value: dict) -> None:
        fs, path = self._path(name)
        part = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/.{name}.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        if fs.exists(path):
            fs.delete(path, False)
        if not fs.rename(part, path):
            raise ConfigCorrupt(f"{name} can't be written")

    def manifest(self) -> dict | None:
        fs, path = self._path("manifest.json")
        if not fs.exists(path):
            return None
        try:
            return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.folder}/manifest.json").collect()))
        except ValueError as e:
            raise ConfigCorrupt(str(e)) from e

    def commit(self, g: Graph, hashes: DataFrame | None = None) -> dict:
        """Write a new generation, then the manifest; readers see the old generation until then."""
        old = self.manifest() or {"generation": 0}
        name = f"g{old['generation'] + 1}-{uuid.uuid4().hex[:8]}"
        g.files.write.parquet(f"{self.folder}/{name}/files")
        g.symbols.write.parquet(f"{self.folder}/{name}/symbols")
        # By kind, so that a query over some kinds reads their directories only.
        g.edges.write.partitionBy("kind").parquet(f"{self.folder}/{name}/edges")
        (hashes if hashes is not None else g.files.select("path", F.hex("sha256").alias("hash"))).write.parquet(f"{self.folder}/{name}/hashes")
        new = {"generation": old["generation"] + 1, "schema": SCHEMA_VERSION, "state": "complete", "tables": name, "built_at": int(time.time())}
        self._write("manifest.json", new)
        return new

    def load(self) -> Graph:
        m = self.manifest()
        if m is None or m.get("state") != "complete":
            raise IndexNotReady("no complete build")
        if m["schema"] != SCHEMA_VERSION:
            raise SchemaVersionMismatch(f"schema {m['schema']}, not {SCHEMA_VERSION}; build again")
        base = f"{self.folder}/{m['tables']}"
        read = self.spark.read
        return Graph(read.schema(FILES).parquet(f"{base}/files"), read.schema(SYMBOLS).parquet(f"{base}/symbols"), self.spark.read.schema(EDGES).parquet(f"{base}/edges").select(*EDGES.names))

    def changes(self, hashes: DataFrame) -> DataFrame:
        """(path, status) of the tree's (path, hash) now against the build's."""
        m = self.manifest()
        if m is None:
            raise IndexNotReady("no build")
        return change_set(self.spark.read.parquet(f"{self.folder}/{m['tables']}/hashes"), hashes)

    def check_fresh(self, hashes: DataFrame, allow_stale: bool = False, shown: int = 20) -> None:
        """StaleIndex with the first dirty paths if the tree has changed."""
        if allow_stale:
            return
        dirty = [r.path for r in self.changes(hashes).where("status != 'unchanged'").orderBy("path").limit(shown).collect()]
        if dirty:
            raise StaleIndex(f"{len(dirty)} or more paths changed since the build", dirty)

    @staticmethod
    def catalog(spark: SparkSession, folders: list[str]) -> DataFrame:
        """(folder, generation, state, built_at) of several stores; missing ones have state `none`."""
        rows = []
        for f in folders:
            m = Store(spark, f).manifest() or {}
            rows.append((f, m.get("generation", 0), m.get("state", "none"), m.get("built_at")))
        return spark.createDataFrame(rows, "folder string, generation long, state string, built_at long")
