"""Result tables that grow: states are taken up as their files arrive.

An addition of this engine: finished files are read whole as plain batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def states(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """A stream of the rows of Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def part_extremes(stream: DataFrame, quantity: str) -> DataFrame:
    """Running statistics of each part, kept as state of fixed size."""
    return stream.groupBy("part_id").agg(F.count(quantity).alias("n"), F.max(quantity).alias("max"), F.min(quantity).alias("min"), F.avg(quantity).alias("mean"), F.stddev_samp(quantity).alias("sd"))


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every batch to a writer, once what there is has been taken up."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
