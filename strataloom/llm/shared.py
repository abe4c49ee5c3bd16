"""Tables in the folder that driver and executors share, and row-to-Arrow glue."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where it is unset."""
    conf = spark.sparkContext.getConf()
    top = conf.get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = getattr(spark.sparkContext, "_strataloom_shared", None)
        if top is None:
            top = "file://" + tempfile.mkdtemp(prefix="strataloom-")
            spark.sparkContext._strataloom_shared = top
    return f"{top.rstrip('/')}/strataloom-{spark.sparkContext.applicationId}"


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the driver's JVM ends."""
    top = shared_dir(spark)
    if getattr(spark.sparkContext, "_strataloom_top", None) != top:
        fs, p = _hadoop_path(spark, top)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        spark.sparkContext._strataloom_top = top
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def brief_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of a query's shuffles when the query ends, unless the session has its own setting.

    Operators here write what later queries need, so a shuffle outlives its use; without this it stays until the driver's
    heap is collected.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, "true")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and later plans see the table's true size, so that
    Spark itself decides about broadcasts.
    """
    path = new_path(df.sparkSession, name)
    brief_shuffles(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._strataloom_path = path
    return out


BATCH_ROWS = 1000


def importable(spark: SparkSession) -> None:
    """Put the folder of this package on the path of the session's Python workers, wherever they start."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [x for x in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if top not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([top, *paths])


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get BATCH_ROWS rows at a time, unless the session has its own number: texts can be long, and
    batches of 10,000 of them take memory on both sides that no Spark setting bounds."""
    importable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing will read again."""
    for df in tables:
        path = getattr(df, "_strataloom_path", None)
        if path:
            fs, p = _hadoop_path(df.sparkSession, path)
            fs.delete(p, True)


def put(uri: str, blob: bytes) -> None:
    """Write a file by a path of any store that Arrow knows; it appears whole, also if a task runs twice."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(blob)
    store.move(part, path)


def get(uri: str) -> bytes:
    """The bytes of a file that put() wrote."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return f.read()


def local_shared_path(spark: SparkSession, path: str) -> str:
    """The POSIX path of a shared path; memory-mapped files need one."""
    fs, p = _hadoop_path(spark, path)
    uri = p.toUri()
    scheme = uri.getScheme() or fs.getUri().getScheme()
    if scheme != "file":
        raise ValueError(f"memory-mapped model files need a mounted spark.checkpoint.dir, not {scheme}://")
    return uri.getPath()
