"""Tables that loops write in the folder which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; a folder of our own only where it is unset."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark.sparkContext, "_strataloom_folder", None)
    if not top and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not top:
        top = spark.sparkContext._strataloom_folder = "file://" + tempfile.mkdtemp(prefix="strataloom-")
    folder = f"{top.rstrip('/')}/graph-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table that any executor can read again; its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
