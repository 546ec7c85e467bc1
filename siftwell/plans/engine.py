"""The engine: one-off searches and searches over indexed projects."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.config import DEFAULT_CHUNK, DEFAULT_MIN_SCORE, DEFAULT_OVERLAP, DEFAULT_TOP
from siftwell.errors import IndexerError
from siftwell.functions.embedding import Embedder, HashedTerms, embedded
from siftwell.operators.chunking import TokenChunker, WordChunker, chunked, labelled
from siftwell.operators.searching import results
from siftwell.operators.vectors import nearest, nearest_chunks
from siftwell.plans.sync import Totals, sync
from siftwell.sources.extract import PlainExtractor, TextExtractor
from siftwell.sources.files import gather, gather_all, path_rows, read_files, read_paths
from siftwell.sources.snapshots import Store


@dataclass
class Engine:
    """The parts that can be replaced, with their defaults."""

    spark: SparkSession
    extractor: TextExtractor = field(default_factory=PlainExtractor)
    chunker: TokenChunker = field(default_factory=lambda: WordChunker(DEFAULT_CHUNK, DEFAULT_OVERLAP))
    embedder: Embedder = field(default_factory=HashedTerms)
    metric: str = "cos"

    def indexed(self, files: DataFrame) -> DataFrame:
        """Chunks of ``files (file_id, file_path, text)`` with labels from 0 and vectors."""
        return labelled(embedded(chunked(files, self.chunker), self.embedder))

    def search_files(self, files: DataFrame, query: str, k: int = DEFAULT_TOP, min_score: float = DEFAULT_MIN_SCORE, paths: list[str] | None = None, keyword: str | None = None) -> DataFrame:
        """Results of ``query`` over the chunks of ``files``, none of which is stored."""
        vector = self.embedder.encode([query], query=True)[0]
        return results(nearest_chunks(files, self.chunker, self.embedder, vector, k, self.metric), None, files, min_score, paths, keyword, k)

    def search_chunks(self, chunks: DataFrame, files: DataFrame, query: str, k: int = DEFAULT_TOP, min_score: float = DEFAULT_MIN_SCORE, paths: list[str] | None = None, keyword: str | None = None) -> DataFrame:
        vector = self.embedder.encode([query], query=True)[0]
        # the columns of the winners come along, so that no chunk is looked up again
        kept = [c for c in ("file_id", "file_path", "chunk_text", "start_char_offset", "end_char_offset") if c in chunks.columns]
        return results(nearest(chunks, vector, k, self.metric, keep=tuple(kept)), None, files, min_score, paths, keyword, k)

    def search_path(self, path: Path, query: str, patterns: list[str] | None = None, **options) -> DataFrame:
        """One-off search over a file or folder; files that cannot be read or hold no text have no chunks."""
        found = gather(path, patterns)
        files = read_files(self.spark, found, self.extractor).where("error is null")
        numbers = self.spark.createDataFrame([(str(p), i) for i, p in enumerate(found)], "file_path string, file_id long")
        return self.search_files(files.join(F.broadcast(numbers), "file_path"), query, **options)

    def open(self, path: str, rebuild: bool = False) -> Store:
        """The store at ``path``; with ``rebuild`` its chunk geometry and embedder may differ from this engine's until it is indexed anew."""
        settings = {"embedder": self.embedder.name, "chunk_size": getattr(self.chunker, "size", None), "chunk_overlap": getattr(self.chunker, "overlap", None)}
        return Store(self.spark, path, settings, rebuild)

    def index(self, store: Store, roots: list[str], patterns: list[str] | None = None, rebuild: bool = False, workers: int | None = None, warn=None) -> Totals:
        """Bring a project's store in line with the files under ``roots``. All are hashed, only new and changed ones parsed."""
        if not roots:
            raise IndexerError("the project has no paths to index")
        found = path_rows(self.spark, gather_all(roots, patterns, warn), workers)
        return sync(store, read_paths(found, None), self.chunker, self.embedder, rebuild, lambda rows: read_paths(rows, self.extractor))

    def search_project(self, store: Store, query: str, **options) -> DataFrame:
        return self.search_chunks(store.chunks, store.files, query, **options)
