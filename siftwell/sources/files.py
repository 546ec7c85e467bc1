"""File discovery and reading."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.config import DEFAULT_PATTERNS
from siftwell.functions.patterns import glob_regex, ignored, parse_rules
from siftwell.sources.extract import TextExtractor, PlainExtractor

#: The rule file that is read in the root of a scan, and only there.
IGNORE_FILE = ".gitignore"


def _walk(root: Path) -> Iterator[Path]:
    """Files below ``root``, links followed, each folder once."""
    seen = set()
    for folder, folders, names in os.walk(root, followlinks=True):
        real = os.path.realpath(folder)
        if real in seen:
            folders.clear()
            continue
        seen.add(real)
        for name in names:
            path = Path(folder, name)
            if path.is_file():
                yield path


def gather(root: Path | str, patterns: list[str] | None = None) -> list[Path]:
    """Resolved files of ``root`` in order: those whose name matches a pattern and that no rule ignores.

    A root that is a file is taken as it is. Rules come from the root's own ignore file; an unreadable
    one filters nothing.
    """
    import re

    root = Path(root)
    if root.is_file():
        return [root.resolve()]
    tests = [re.compile(glob_regex(p)).match for p in (DEFAULT_PATTERNS if patterns is None else patterns)]
    try:
        rules = parse_rules((root / IGNORE_FILE).read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError):
        rules = []
    found = {p.resolve() for p in _walk(root) if any(t(p.name) for t in tests) and not ignored(p.relative_to(root).as_posix(), rules)}
    return sorted(found)


def gather_all(roots: list[Path | str], patterns: list[str] | None = None, warn=None) -> list[Path]:
    """Union of several roots, each with its own rules; a missing root is reported and passed over."""
    found: set[Path] = set()
    for root in roots:
        if Path(root).exists():
            found.update(gather(root, patterns))
        elif warn:
            warn(f"{root} does not exist and is skipped")
    return sorted(found)


READ = "file_path string, file_size_bytes long, last_modified_os timestamp, content_hash string, text string, error string"


def read_files(spark: SparkSession, paths: list[Path], extractor: TextExtractor | None = None, partitions: int | None = None) -> DataFrame:
    """``file_path, file_size_bytes, last_modified_os, content_hash, text, error`` of each path, read by the executors.

    A file that cannot be read is a row with its error and no hash; one that cannot be parsed has
    empty text. The listing is the driver's, so executors must see the same folders, as with any
    file:// source.
    """
    return read_paths(path_rows(spark, paths, partitions), extractor or PlainExtractor())


def path_rows(spark: SparkSession, paths: list[Path], partitions: int | None = None) -> DataFrame:
    """``file_path`` of ``paths``, dealt over the executors."""
    width = partitions or max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(str(p),) for p in paths], "file_path string").repartition(width)


def read_paths(rows: DataFrame, extractor: TextExtractor | None) -> DataFrame:
    """As :func:`read_files`, for ``rows (file_path)``; without an extractor the files are only hashed and have no text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    stat, raw = os.stat(path), Path(path).read_bytes()
                except OSError as e:
                    rows.append((path, None, None, None, None, str(e)))
                    continue
                text = None if extractor is None else extractor.extract(path, raw)
                rows.append((path, stat.st_size, int(stat.st_mtime * 1_000_000), hashlib.sha256(raw).hexdigest(), text, None))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    return rows.select("file_path").mapInArrow(read, READ)


def documents_as_files(docs: DataFrame) -> DataFrame:
    """A documents table in the shape of files: id, made-up path, text, hash and size."""
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(
        F.col("doc_id").alias("file_id"), path.alias("file_path"), "text", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("file_size_bytes")
    )
