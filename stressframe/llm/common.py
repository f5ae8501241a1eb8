"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}  # folders made where none is set, by application


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by the driver and all executors: ``spark.checkpoint.dir``.

    Only where it is unset on a single machine (tests) a new local folder is made; on a
    cluster each executor would write to a disk of its own, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        name = spark.sparkContext.applicationId
        if name not in _OWN:
            _OWN[name] = "file://" + tempfile.mkdtemp(prefix="stressframe-")
        found = _OWN[name]
    return found.rstrip("/")


#: Setting under which the shuffle files of a plan go when it has run.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Plans run inside drop their shuffle files when they end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


#: Bytes that are handed to Python at once about, where by default 10,000 rows go together, however long; rows that a Parquet reader holds at once.
BATCH_BYTES, READ_ROWS = 4 << 20, 1024
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS)}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans run inside read and hand on texts in small batches, so these take little memory of the JVM and of Python."""
    before = {k: spark.conf.get(k, None) for k in _BATCHES}
    for k, v in _BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a DataFrame that reads it.

    Cuts lineage and survives lost executors. The files go by ``release``, or when the
    driver's Hadoop file system is closed at exit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/part-{uuid.uuid4().hex}"
    with shuffles_dropped(spark), small_batches(spark):
        df.write.parquet(path)
    files, at = _path(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for made in _MADE:
        made.append(out)
    return out


_MADE: list[list[DataFrame]] = []  # tables made inside ``tables_dropped``


@contextmanager
def tables_dropped() -> Iterator[None]:
    """Tables that ``materialize`` makes inside go at the end, when what was made of them has been written."""
    made: list[DataFrame] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE.remove(made)
        release(*made)


def delete_folder(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Delete a folder of the shared folder, now or when the driver's file system is closed."""
    files, at = _path(spark, path)
    files.deleteOnExit(at) if at_exit else files.delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` gave, when nothing is to read them any more."""
    for df in tables:
        files, at = _path(df.sparkSession, df._stored_at)
        files.delete(at, True)


#: Slots of ``split_by``; this bounds what it broadcasts.
SLOTS = 1 << 20


def split_by(df: DataFrame, key: Column, keys: DataFrame, of: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` can't be among ``keys``, the other rows).

    Keys are hashed to SLOTS slots, and the slots in use are broadcast: rows of the first
    part need no shuffle to be told from the others, of which a few are not among the keys.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    slots = F.broadcast(keys.select(slot(F.col(of)).alias("__slot")).distinct())  # SLOTS rows at most
    match = slot(key) == F.col("__slot")
    return df.join(slots, match, "left_anti"), df.join(slots, match, "left_semi")


#: Keys with more than this share of all rows are joined without a shuffle; there are at most 1 / HOT of them.
HOT = 1 / 1000


def join_hot(rows: DataFrame, key: str, table: DataFrame, of: str, size: str, total: int) -> DataFrame:
    """``rows`` left-joined to ``table``, which has one row for each of its keys (``of``) and how many rows have it (``size``).

    Keys of more than HOT of the ``total`` rows are broadcast, and their rows go anywhere,
    so no task gets all rows of one key.
    """
    values = [c for c in table.columns if c != of]
    held = F.struct(*values)
    hot = table.where(F.col(size) > HOT * total).select(F.col(of).alias("__hk"), held.alias("__hv"))  # 1 / HOT rows at most
    cold = table.where(F.col(size) <= HOT * total).select(F.col(of).alias("__ck"), held.alias("__cv"))
    warm = rows.join(F.broadcast(hot), F.col(key) == F.col("__hk"), "left")
    anywhere = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if rows.schema[c].dataType.simpleString() in ("string", "int", "bigint")]).cast(rows.schema[key].dataType)
    warm = warm.withColumn("__at", F.when(F.col("__hk").isNull(), F.col(key)).otherwise(anywhere))
    out = warm.join(cold, F.col("__at") == F.col("__ck"), "left").withColumn("__v", F.when(F.col("__hk").isNull(), F.col("__cv")).otherwise(F.col("__hv")))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col("__v")[c].alias(c) for c in values])
