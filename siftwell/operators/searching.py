"""From scored labels to search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.config import DEFAULT_MIN_SCORE
from siftwell.functions.patterns import keyword_like, path_like

DETAILS = ["label", "file_path", "chunk_text", "start_char_offset", "end_char_offset"]


def chunk_details(chunks: DataFrame, files: DataFrame, labels: DataFrame | None = None, paths: list[str] | None = None, keyword: str | None = None) -> DataFrame:
    """Chunks joined with their files; only those in ``labels``, under ``paths`` and with ``keyword``, as far as given."""
    if labels is not None:
        chunks = chunks.join(labels.select("label"), "label", "left_semi")
    both = chunks.join(files.select("file_id", "file_path"), "file_id").select(*DETAILS)
    for test in (path_like(F.col("file_path"), paths), keyword_like(F.col("chunk_text"), keyword)):
        if test is not None:
            both = both.where(test)
    return both


def lookup(chunks: DataFrame, files: DataFrame, label: int) -> DataFrame:
    """Details of one chunk; no row if it is missing."""
    return chunk_details(chunks.where(F.col("label") == label), files)


#: Hits up to this many rows are broadcast; more are joined.
BROADCAST_HITS = 10_000


def results(hits: DataFrame, chunks: DataFrame | None, files: DataFrame, min_score: float = DEFAULT_MIN_SCORE, paths: list[str] | None = None, keyword: str | None = None, k: int | None = None) -> DataFrame:
    """Results for ``hits (label, score)``, which are already the best k of all chunks.

    Filters come after the best k are taken, so fewer rows may remain. Without ``chunks`` the hits
    already hold the columns of theirs; otherwise text is read only for those labels.
    """
    small = (lambda df: F.broadcast(df)) if k is None or k <= BROADCAST_HITS else (lambda df: df)
    if chunks is not None:
        hits = chunks.join(small(hits), "label")
    both = hits if "file_path" in hits.columns else files.select("file_id", "file_path").join(small(hits), "file_id")
    both = both.where(F.col("score") >= min_score)
    for test in (path_like(F.col("file_path"), paths), keyword_like(F.col("chunk_text"), keyword)):
        if test is not None:
            both = both.where(test)
    return both.select("label", "score", "file_path", "chunk_text", "start_char_offset", "end_char_offset").orderBy(F.desc("score"), "label")
