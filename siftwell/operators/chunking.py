"""Overlapping token windows over texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import ZERO_WIDTH
from siftwell.session import ensure_checkpoint_dir, small_batches

_token = re.compile("[^ \t\n\r\f]+")
_zero_width = str.maketrans("", "", ZERO_WIDTH)


class Chunk(NamedTuple):
    text: str
    start: int
    end: int
    tokens: int


class TokenChunker(Protocol):
    def chunk(self, text: str) -> list[Chunk]: ...


class WordChunker:
    """Windows of ``size`` white-space tokens that share ``overlap`` tokens with the one before.

    Windows start at every multiple of ``size - overlap`` below the token count, so the last may lie
    inside its predecessor. A chunk's text is its tokens joined by single spaces; offsets are those of
    its first and last token in the source. Windows of nothing but invisible characters are dropped.
    """

    def __init__(self, size: int = 128, overlap: int = 20):
        if size <= 0:
            raise ValueError("chunk size must be positive")
        if overlap < 0 or overlap >= size:
            raise ValueError("overlap must be at least 0 and smaller than the chunk size")
        self.size, self.overlap = size, overlap

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        return [(m.start(), m.end(), m.group()) for m in _token.finditer(text)]

    def join(self, tokens: list[str]) -> str:
        return " ".join(tokens)

    def chunk(self, text: str) -> list[Chunk]:
        if not text.strip():
            return []
        found, out = self.spans(text), []
        for at in range(0, len(found), self.size - self.overlap):
            window = found[at : at + self.size]
            joined = self.join([t for _, _, t in window])
            if joined.translate(_zero_width).strip():
                out.append(Chunk(joined, window[0][0], window[-1][1], len(window)))
        return out


class TokenizerChunker(WordChunker):
    """The same windows over the tokens of a ``tokenizers`` file, without special tokens."""

    def __init__(self, path: str, size: int = 128, overlap: int = 20):
        super().__init__(size, overlap)
        self.path, self._tokenizer = path, None

    def __getstate__(self):
        return self.__dict__ | {"_tokenizer": None}

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
            self._tokenizer.no_truncation()
        return self._tokenizer

    def spans(self, text: str):
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return [(a, b, i) for (a, b), i in zip(found.offsets, found.ids, strict=True)]

    def join(self, tokens) -> str:
        return self.tokenizer.decode(tokens, skip_special_tokens=True)


#: Characters of windows that a worker hands on together.
HELD = 1 << 20
CHUNK_COLUMNS = "chunk_no int, chunk_text string, start_char_offset int, end_char_offset int, token_count int"


def chunked(files: DataFrame, chunker: TokenChunker | None = None, text_col: str = "text", keep: tuple[str, ...] = ("file_id", "file_path")) -> DataFrame:
    """One row per window of each file: the ``keep`` columns and those of a chunk, numbered from 0."""
    narrow = _texts(files, text_col, keep)
    out = chunk_schema(narrow)
    return narrow.mapInArrow(cutter(chunker or WordChunker(), out.names), out)


def _texts(files: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns and ``_text`` of the files that have one."""
    small_batches(files.sparkSession)
    return files.select(*keep, F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())


def chunk_schema(narrow: DataFrame):
    from pyspark.sql.types import StructType

    return StructType([*narrow.schema.fields[:-1], *StructType.fromDDL(CHUNK_COLUMNS).fields])


def cutter(chunker: TokenChunker, names: list[str]):
    """A worker that cuts the texts in the last column; it hands on windows once they hold HELD characters."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                for n, c in enumerate(chunker.chunk(text.as_py())):
                    rows.append((i, n, c))
                    held += len(c.text)
                    if held >= HELD:
                        yield _cut_rows(batch, rows, names)
                        rows, held = [], 0
            if rows:
                yield _cut_rows(batch, rows, names)

    return cut


def _cut_rows(batch: pa.RecordBatch, rows: list[tuple[int, int, Chunk]], names: list[str]) -> pa.RecordBatch:
    at = pa.array([i for i, _, _ in rows], pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            *[batch.column(k).take(at) for k in range(batch.num_columns - 1)],
            pa.array([n for _, n, _ in rows], pa.int32()), pa.array([c.text for _, _, c in rows], pa.string()),
            pa.array([c.start for _, _, c in rows], pa.int32()), pa.array([c.end for _, _, c in rows], pa.int32()),
            pa.array([c.tokens for _, _, c in rows], pa.int32()),
        ],
        names=names,
    )


def chunk_counts(files: DataFrame, chunker: TokenChunker, text_col: str = "text") -> DataFrame:
    """``file_path, n``: windows of each file; no window leaves its worker."""
    narrow = _texts(files, text_col, ("file_path",))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(chunker.chunk(text.as_py())) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["file_path", "n"])

    return narrow.mapInArrow(count, "file_path string, n long").groupBy("file_path").agg(F.sum("n").alias("n"))


def window_starts(n_tokens: Column, size: int, overlap: int) -> Column:
    """Starts of the windows over ``n_tokens`` tokens, as an array; empty for none."""
    return F.when(n_tokens > 0, F.sequence(F.lit(0), n_tokens - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))


def labelled(chunks: DataFrame, base: int | Column = 0) -> DataFrame:
    """``chunks`` with ``label``: consecutive from ``base`` in the order of file path and chunk number.

    Files are ordered over all partitions: range-partitioned, summed within each partition, and moved
    by the totals of the partitions before; no task sees all files.
    """
    first = first_labels(chunks.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")))
    start = base if isinstance(base, Column) else F.lit(base)
    return chunks.join(first, "file_path").withColumn("label", (F.col("first") + F.col("chunk_no") + start).cast("long")).drop("first")


def first_labels(per_file: DataFrame) -> DataFrame:
    """``file_path, first`` for ``per_file (file_path, n)``: the chunks of the files before, in the order of file path."""
    spark = per_file.sparkSession
    ensure_checkpoint_dir(spark)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_files = per_file.repartitionByRange(width, "file_path").withColumn("part", F.spark_partition_id()).checkpoint()
    totals = {r["part"]: r["n"] for r in sorted_files.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, moved = 0, []
    for part in sorted(totals):
        moved.append((part, before))
        before += totals[part]
    offsets = spark.createDataFrame(moved, "part int, before long")
    running = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sorted_files.withColumn("running", running).join(F.broadcast(offsets), "part").select("file_path", (F.col("before") + F.col("running")).alias("first"))


def next_label(stored: Column, highest: Column) -> Column:
    """Where labels go on: behind the stored value if it is a number, else behind the highest in use, else 0."""
    return F.coalesce(stored.try_cast("long"), highest, F.lit(-1)) + 1
