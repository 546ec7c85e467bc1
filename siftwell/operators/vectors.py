"""Similarity search over a table of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.errors import VectorStoreError
from siftwell.session import ARROW_ROWS, small_batches

METRICS = ("cos", "ip", "l2sq")


def similarity(distance: Column, metric: str) -> Column:
    """Score of a distance: 1 - d for cosine and inner product, 1 / (1 + d) for squared L2, else -d."""
    if metric in ("cos", "ip"):
        return 1 - distance
    return 1 / (1 + distance) if metric == "l2sq" else -distance


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str) -> Column:
    """Distance of two vectors; a zero vector has similarity 0 to all under cosine. Other metrics act as squared L2."""
    if metric == "cos":
        return 1 - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
    if metric == "ip":
        return 1 - dot(a, b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def scores(vectors: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    """Scores (n, queries) of a batch, as :func:`similarity` of :func:`distance`, to 9 places, by which they are ranked."""
    v, q = vectors.astype(np.float64), query.astype(np.float64)
    if metric == "cos":
        norms = np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
        found = np.divide(v @ q.T, norms, out=np.zeros((len(v), len(q))), where=norms > 0)
    elif metric == "ip":
        found = v @ q.T
    else:
        d = np.maximum((v * v).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * v @ q.T, 0)
        found = 1 / (1 + d) if metric == "l2sq" else -d
    # halves are rounded away from zero, as the SQL function does
    return np.sign(found) * np.floor(np.abs(found) * 1e9 + 0.5) / 1e9


def check_query(query, ndim: int | None, k: int) -> np.ndarray:
    """One query vector as (1, ndim)."""
    q = np.atleast_2d(np.asarray(query, np.float32))
    if k <= 0:
        raise ValueError("k must be positive")
    if q.ndim != 2 or q.shape[0] != 1:
        raise ValueError("search takes one query at a time")
    if ndim is not None and q.shape[1] != ndim:
        raise ValueError(f"the query has {q.shape[1]} dimensions, the index {ndim}")
    return q


def _matrix(column: pa.Array, ndim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != ndim * len(column):
        raise ValueError(f"every vector must have {ndim} dimensions")
    return flat.reshape(-1, ndim)


def nearest(vectors: DataFrame, query, k: int = 5, metric: str = "cos", label_col: str = "label", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """``label, score`` and the ``keep`` columns of the ``k`` best vectors, score descending, then label.

    Every batch is scored by one matrix product and every task hands on its own best ``k``, so what is
    sorted is small however many vectors there are. Fewer vectors than ``k`` give them all. Ranks go by
    scores to 9 places; 6 are returned.
    """
    from pyspark.sql.types import StructType

    small_batches(vectors.sparkSession)
    q = check_query(query, None, k)
    narrow = vectors.select(F.col(label_col).cast("long").alias("label"), *keep, F.col(vector_col).alias("_vector"))
    shape = StructType([*narrow.schema.fields[:-1], *StructType.fromDDL("score double").fields])
    ranked = narrow.mapInArrow(best_of_task(q, k, metric, "_vector", ("label",)), shape).orderBy(F.desc("score"), "label").limit(k)
    return ranked.select("label", F.round("score", 6).alias("score"), *keep)


#: Rows that a task gathers before it looks for its best anew.
GATHERED = 4096


def best_of_task(q: np.ndarray, k: int, metric: str, vector_col: str, order: tuple[str, ...]):
    """A worker that puts ``score`` in the place of the vectors and hands on its best ``k`` rows, by score and then ``order``."""
    import pyarrow.compute as pc

    keys = [("score", "descending"), *[(c, "ascending") for c in order]]

    def pruned(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts)
        return table.take(pc.sort_indices(table, sort_keys=keys)[:k])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        kept = fresh = 0
        for batch in batches:
            if batch.num_rows:
                at = batch.schema.get_field_index(vector_col)
                found = scores(_matrix(batch.column(at), q.shape[1]), q, metric)[:, 0]
                own = pa.Table.from_batches([batch]).drop_columns([vector_col]).append_column("score", pa.array(found))
                # a batch gives its own best at most, copied so that the batch can go
                held.append(pruned([own]))
                fresh += len(held[-1])
                if fresh >= max(GATHERED, kept):
                    held = [pruned(held)]
                    kept, fresh = len(held[0]), 0
        if held:
            yield from pruned(held).combine_chunks().to_batches()

    return best


def nearest_chunks(files: DataFrame, chunker, embedder, query, k: int = 5, metric: str = "cos", keep: tuple[str, ...] = ("file_id", "file_path")) -> DataFrame:
    """``score, label``, the columns of a chunk and the ``keep`` columns of the ``k`` best chunks of ``files``, by score and then label.

    A file is cut, embedded and scored by one worker, from which only the best ``k`` of its task go on, in the order of
    file path and chunk number, which is that of labels; so labels are needed for the winners alone.
    """
    from pyspark.sql.types import StructType

    from siftwell.functions.embedding import encoder
    from siftwell.operators.chunking import _texts, chunk_counts, chunk_schema, cutter, first_labels

    q = check_query(query, None, k)
    narrow = _texts(files.where("file_path is not null"), "text", keep)
    out = chunk_schema(narrow)
    cut, encode, best = cutter(chunker, out.names), encoder(embedder, "chunk_text"), best_of_task(q, k, metric, "embedding", ("file_path", "chunk_no"))
    shape = StructType([*out.fields, *StructType.fromDDL("score double").fields])
    found = narrow.mapInArrow(lambda batches: best(encode(_split(cut(batches)))), shape)
    winners = found.orderBy(F.desc("score"), "file_path", "chunk_no").limit(k)
    firsts = first_labels(chunk_counts(files, chunker))
    few = F.broadcast(winners) if k <= BROADCAST_WINNERS else winners
    return firsts.join(few, "file_path").select(F.round("score", 6).alias("score"), (F.col("first") + F.col("chunk_no")).cast("long").alias("label"), *[c for c in out.names])


#: Winners up to this many are broadcast to find their labels.
BROADCAST_WINNERS = 10_000


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ARROW_ROWS):
            yield batch.slice(at, ARROW_ROWS)


def nearest_of_many(vectors: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cos", label_col: str = "label", vector_col: str = "embedding", query_rows: int = 10_000) -> DataFrame:
    """``query_id, label, score, rank`` of the ``k`` best vectors for each row of ``queries (query_id, query)``.

    The queries are a stated set: they go to every task, in blocks of ``query_rows`` that are read from
    the driver's side one after another, so that any number of them fits. Each task keeps its best ``k``
    a query before anything moves. Ranks go by scores to 9 places; 6 are returned.
    """
    small_batches(vectors.sparkSession)
    narrow = vectors.select(F.col(label_col).cast("long"), F.col(vector_col))

    def of_block(ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = np.full((0, len(ids)), -np.inf), np.zeros((0, len(ids)), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                labels = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                own = _matrix(batch.column(1), matrix.shape[1])
                merged = []
                for first in range(0, len(ids), 256):
                    part = slice(first, first + 256)
                    found = np.concatenate([top[0][:, part], scores(own, matrix[part], metric)])
                    named = np.concatenate([top[1][:, part], np.repeat(labels[:, None], found.shape[1], axis=1)])
                    by_label = np.argsort(named, axis=0, kind="stable")
                    found, named = np.take_along_axis(found, by_label, 0), np.take_along_axis(named, by_label, 0)
                    at = np.argsort(-found, axis=0, kind="stable")[:k]
                    merged.append((np.take_along_axis(found, at, 0), np.take_along_axis(named, at, 0)))
                top = tuple(np.concatenate([m[i] for m in merged], axis=1) for i in (0, 1))
            if len(top[0]):
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.tile(ids, len(top[0]))), "label": pa.array(top[1].reshape(-1)), "score": pa.array(top[0].reshape(-1))})

        found = narrow.mapInArrow(best, "query_id long, label long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "label"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", F.round("score", 6))

    out, rows = None, []

    def add(rows: list) -> None:
        nonlocal out
        block = of_block(np.array([r["query_id"] for r in rows], np.int64), np.array([r["query"] for r in rows], np.float32).reshape(len(rows), -1))
        out = block if out is None else out.unionByName(block)

    for row in queries.select("query_id", "query").toLocalIterator():
        rows.append(row)
        if len(rows) == query_rows:
            add(rows)
            rows = []
    if rows or out is None:
        add(rows)
    return out


def nearest_by_lsh(spark: SparkSession, vectors: DataFrame, query, k: int = 5, tables: int = 16, width: float = 0.8, label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """Approximate cosine search for unit vectors by random projections; candidates are scored exactly."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    q = check_query(query, None, k)[0]
    data = vectors.select(F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding"), array_to_vector(F.col(vector_col).cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=7).fit(data)
    near = model.approxNearestNeighbors(data, Vectors.dense(q.astype(float)), 4 * k)
    return nearest(near.select("label", "embedding"), q, k, "cos")


def check_vectors(vectors: DataFrame, ndim: int, vector_col: str = "embedding") -> DataFrame:
    """``vectors`` that fail when read if a vector is missing or has another length."""
    good = F.coalesce(F.size(vector_col) == ndim, F.lit(False))
    return vectors.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit(f"every vector must have {ndim} dimensions")).cast("boolean")))


class ExactIndex:
    """A label-to-vector table with the operations of a vector index; nothing is changed in place."""

    def __init__(self, vectors: DataFrame, ndim: int, metric: str = "cos"):
        self.vectors, self.ndim, self.metric = vectors.select(F.col("label").cast("long").alias("label"), "embedding"), ndim, metric

    @classmethod
    def empty(cls, spark: SparkSession, ndim: int, metric: str = "cos") -> ExactIndex:
        return cls(spark.createDataFrame([], "label long, embedding array<float>"), ndim, metric)

    def __len__(self) -> int:
        return self.vectors.count()

    def add(self, labels, vectors) -> ExactIndex:
        """The index with more vectors; none is no change."""
        v, keys = np.asarray(vectors, np.float32), np.asarray(labels)
        if v.ndim != 2:
            raise ValueError("vectors must be a matrix")
        if keys.ndim != 1 or len(keys) != len(v):
            raise ValueError("there must be one label for each vector")
        if not len(v):
            return self
        if v.shape[1] != self.ndim:
            raise ValueError(f"every vector must have {self.ndim} dimensions")
        rows = [(int(k), x.tolist()) for k, x in zip(keys, v, strict=True)]
        more = self.vectors.sparkSession.createDataFrame(rows, "label long, embedding array<float>")
        return ExactIndex(self.vectors.unionByName(more), self.ndim, self.metric)

    def remove(self, labels: DataFrame) -> ExactIndex:
        """The index without ``labels (label)``; labels it lacks are passed over."""
        return ExactIndex(self.vectors.join(labels.select("label"), "label", "left_anti"), self.ndim, self.metric)

    def keys(self) -> DataFrame:
        return self.vectors.select("label")

    def search(self, query, k: int = 5) -> DataFrame:
        return nearest(self.vectors, check_query(query, self.ndim, k)[0], k, self.metric)

    def save(self, path: str) -> None:
        """The index becomes the current table of the folder ``path``; readers see the one before or this one."""
        from siftwell.sources.snapshots import save_table

        save_table(self.vectors, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, ndim: int, metric: str = "cos") -> ExactIndex:
        from siftwell.sources.snapshots import exists, load_table

        if not exists(spark, path):
            raise FileNotFoundError(path)
        try:
            return cls(load_table(spark, path), ndim, metric)
        except Exception as e:
            raise VectorStoreError(f"{path} holds no vectors: {e}") from e
