"""Indexing files as they arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.plans.sync import sync
from siftwell.sources.snapshots import Store


def arriving(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """New text files of ``folder`` in the columns that :func:`siftwell.plans.sync.sync` reads."""
    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

    shape = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])
    found = spark.readStream.format("binaryFile").schema(shape).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True).load(folder)
    return found.select(
        F.regexp_replace("path", "^file:/*", "/").alias("file_path"),
        F.col("length").alias("file_size_bytes"),
        F.col("modificationTime").alias("last_modified_os"),
        F.sha2("content", 256).alias("content_hash"),
        F.decode("content", "UTF-8").alias("text"),
        F.lit(None).cast("string").alias("error"),
    )


def index_arrivals(store: Store, arrivals: DataFrame, checkpoint: str) -> StreamingQuery:
    """Each micro-batch joins the store: a path that came before is replaced, nothing is pruned.

    A batch that is repeated after a failure finds its files unchanged, so each is indexed once.
    """

    def add(batch: DataFrame, _: int) -> None:
        rest = store.files.join(batch.select("file_path"), "file_path", "left_anti")
        known = rest.select("file_path", "file_size_bytes", "last_modified_os", "content_hash", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("error"))
        sync(store, batch.dropDuplicates(["file_path"]).unionByName(known))

    return arrivals.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
