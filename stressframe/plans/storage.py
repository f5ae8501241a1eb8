"""Cut lineage by tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}  # folders made where none is set, by application


def folder_of(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on a single machine where it is unset, a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        name = spark.sparkContext.applicationId
        folder = _OWN.setdefault(name, "") or "file://" + tempfile.mkdtemp(prefix="stressframe-")
        _OWN[name] = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes with the application."""
    path = f"{folder_of(spark)}/table-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete what was written to a path, when nothing is to read it any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` gave, when nothing is to read them any more."""
    for df in tables:
        discard(df.sparkSession, df._stored_at)
