"""The built-in embedder: hashed term counts.

It measures shared vocabulary, not meaning; a neural model can take its place through
:class:`siftwell.plans.engine.Engine` without touching the rest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from siftwell.session import small_batches

DIMENSIONS = 256
#: Words whose buckets a worker remembers.
KNOWN_WORDS = 100_000
_words = regex.compile(r"[\p{L}\p{N}]+").findall


class Embedder(Protocol):
    """Texts to vectors of one length; ``query`` marks search texts, which some models prompt differently."""

    name: str
    ndim: int

    def encode(self, texts: list[str], query: bool = False) -> np.ndarray: ...


class HashedTerms:
    """Counts of words by hash bucket. Words are hashed once a worker while they stay in use."""

    name = "hashed-terms-256"

    def __init__(self, ndim: int = DIMENSIONS):
        self.ndim = ndim
        self._bucket: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        found = self._bucket.get(word)
        if found is None:
            if len(self._bucket) > KNOWN_WORDS:
                self._bucket.clear()
            found = self._bucket[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.ndim
        return found

    def encode(self, texts: list[str], query: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.ndim), np.float32)
        for row, text in zip(out, texts, strict=True):
            found = [self.bucket(w) for w in _words(text.lower())]
            row += np.bincount(found, minlength=self.ndim) if found else 0
        return out


class PromptedModel:
    """Wraps a model object with ``encode``; models of the "qwen" family get a prompt with queries."""

    def __init__(self, name: str, load):
        self.name, self._load, self._model, self._ndim = name, load, None, None

    @property
    def model(self):
        if self._model is None:
            self._model = self._load(self.name)
        return self._model

    @property
    def ndim(self) -> int:
        if self._ndim is None:
            self._ndim = int(np.asarray(self.model.encode([" "])).shape[1])
        return self._ndim

    def encode(self, texts: list[str], query: bool = False) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.ndim), np.float32)
        more = {"prompt_name": "query"} if query and re.search("qwen", self.name, re.I) else {}
        return np.asarray(self.model.encode(texts, **more), np.float32)


def embedded(chunks: DataFrame, embedder: Embedder, text_col: str = "chunk_text") -> DataFrame:
    """``chunks`` with ``embedding array<float>``, encoded batch by batch on the executors."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    small_batches(chunks.sparkSession)
    out = StructType([*chunks.schema.fields, StructField("embedding", ArrayType(FloatType()))])
    return chunks.mapInArrow(encoder(embedder, text_col), out)


def encoder(embedder: Embedder, text_col: str):
    """A worker that adds the vectors of its texts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = embedder.encode(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            flat = pa.array(np.ascontiguousarray(vectors, np.float32).reshape(-1))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * embedder.ndim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, flat)], names=[*batch.schema.names, "embedding"])

    return encode
