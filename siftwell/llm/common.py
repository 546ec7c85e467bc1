"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftwell.session import ensure_checkpoint_dir, share_code

#: Rows of whole texts that go to a Python worker at once. A text can be long; the batch stays small.
ARROW_ROWS = 256
#: ASCII white space that separates words in the word-level operators.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, importable code and small Arrow batches for operators that read texts."""
    ensure_checkpoint_dir(spark)
    share_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: lineage ends there and a lost executor costs nothing.

    Shuffle files of steps that were pinned before, and that nothing refers to any more, are given up
    first; Spark would keep them until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written like :func:`pinned`, but as compressed columns, of which later steps read those that they name."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def text_of(docs: DataFrame, text_col: str) -> Column:
    """The text as a string, null taken as empty."""
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_texts(docs: DataFrame, id_col: str, text_col: str, schema: str, worker) -> DataFrame:
    """Each (id, text) through ``worker()``, which is made once a task and maps two lists to columns.

    ``schema`` lists the columns behind ``doc_id``; the worker returns the row's position in its batch
    (so that one text may give several rows) and those columns. Only id and text leave the scan.
    """
    import pyarrow as pa

    prepare(docs.sparkSession)
    pair = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"))
    out = StructType([pair.schema["doc_id"], *StructType.fromDDL(schema).fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target, work = to_arrow_schema(out), worker()
        for batch in batches:
            at, columns = work(batch.column(1).to_pylist())
            ids = batch.column(0) if at is None else batch.column(0).take(pa.array(at, pa.int64()))
            arrays = [pa.array(c, f.type) for c, f in zip(columns, list(target)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids.cast(target.field(0).type), *arrays], schema=target)

    return pair.mapInArrow(run, out)
