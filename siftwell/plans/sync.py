"""Incremental index maintenance."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.embedding import Embedder, HashedTerms, embedded
from siftwell.operators.chunking import TokenChunker, WordChunker, chunked, labelled
from siftwell.session import ensure_checkpoint_dir
from siftwell.sources.snapshots import MAX_LABEL, Store, upserted


class Totals(NamedTuple):
    processed: int
    chunks: int
    errors: int


def classified(stored: DataFrame, current: DataFrame) -> DataFrame:
    """``file_path, file_id, status`` of all stored and current files, by path and content hash.

    ``deleted`` means not in the current scan, whatever the reason. A current row without a hash could
    not be read: ``error``, which also takes a stored copy out.
    """
    s = stored.select("file_path", F.col("file_id").alias("file_id"), F.col("content_hash").alias("old_hash"))
    c = current.select("file_path", F.col("content_hash").alias("new_hash"), F.lit(True).alias("here"))
    status = (
        F.when(F.col("here").isNull(), "deleted")
        .when(F.col("new_hash").isNull(), "error")
        .when(F.col("file_id").isNull(), "new")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("changed")
    )
    return s.join(c, "file_path", "full_outer").select("file_path", "file_id", status.alias("status"))


def removed_labels(chunks: DataFrame, status: DataFrame) -> DataFrame:
    """Labels of the chunks of files that are gone or changed."""
    gone = status.where(F.col("status").isin("deleted", "changed", "error")).select("file_id")
    return chunks.join(gone, "file_id", "left_semi").select("label")


def totals(status: DataFrame) -> DataFrame:
    """``status, files``."""
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def sync(store: Store, current: DataFrame, chunker: TokenChunker | None = None, embedder: Embedder | None = None, rebuild: bool = False, read: Callable[[DataFrame], DataFrame] | None = None) -> Totals:
    """Bring ``store`` in line with ``current`` (the columns of :func:`siftwell.sources.files.read_files`).

    Unchanged files keep their rows; changed and new ones are chunked and embedded; deleted ones go.
    Everything, a rebuild too, lands in one snapshot. Labels are never used twice, not even by a
    rebuild. ``read`` gives the rows of new and changed paths with their text, if ``current`` has none.
    Files without text get a file row and no chunk. Returns files processed (unchanged ones too), chunks
    made, errors.
    """
    chunker, embedder = chunker or WordChunker(), embedder or HashedTerms()
    spark = current.sparkSession
    ensure_checkpoint_dir(spark)
    stored_files, stored_chunks = store.files, store.chunks
    # what was read is fixed here: files that change later, or are read again by another executor, must not matter
    current = current.checkpoint()
    known = stored_files.where(F.lit(not rebuild))
    status = classified(known, current)
    fresh = current.join(status.where(F.col("status").isin("new", "changed")).select("file_path"), "file_path", "left_semi")
    if read is not None:
        fresh = read(fresh.select("file_path")).checkpoint()
        lost = fresh.where(F.col("content_hash").isNull()).select("file_path", F.lit("error").alias("failed"))
        status = status.join(lost, "file_path", "left").withColumn("status", F.coalesce("failed", "status")).drop("failed")
        fresh = fresh.where(F.col("content_hash").isNotNull())
    status = status.checkpoint()

    tops = stored_chunks.agg(F.max("label").alias("label")).first()["label"], stored_files.agg(F.max("file_id").alias("file")).first()["file"]
    counter = store.max_label()
    label = (counter if counter is not None else tops[0] if tops[0] is not None else -1) + 1
    numbered = _numbered(fresh, 0 if tops[1] is None else tops[1] + 1)
    new_chunks = labelled(embedded(chunked(numbered, chunker), embedder), label)
    new_chunks = new_chunks.withColumn("chunk_id", F.col("label")).select(stored_chunks.columns).checkpoint()
    new_files = numbered.withColumn("last_indexed_at", F.current_timestamp()).select(stored_files.columns)
    kept_files = stored_files.join(status.where("status = 'unchanged'").select("file_path"), "file_path", "left_semi").select(stored_files.columns)
    kept_chunks = stored_chunks.join(kept_files.select("file_id"), "file_id", "left_semi").select(stored_chunks.columns)

    made = new_chunks.agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("top")).first()
    top = made["top"] if made["top"] is not None else label - 1
    values = store.key_values
    if top >= 0:
        values = upserted(values, spark.createDataFrame([(MAX_LABEL, str(top))], "key string, value string"))
    store.commit(files=kept_files.unionByName(new_files), chunks=kept_chunks.unionByName(new_chunks), key_values=values)
    n = {r["status"]: r["files"] for r in totals(status).collect()}
    return Totals(sum(n.get(s, 0) for s in ("new", "changed", "unchanged")), made["n"], n.get("error", 0))


def _numbered(files: DataFrame, base: int) -> DataFrame:
    """``files`` with ``file_id`` from ``base`` in path order."""
    ids = labelled(files.select("file_path", F.lit(0).alias("chunk_no")), base).select("file_path", F.col("label").alias("file_id"))
    return files.join(ids, "file_path")
