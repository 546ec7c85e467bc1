"""Packing documents into token sequences: large-item matching, then best fit.

The plan needs only how many pieces there are of each length, a histogram with at most
``capacity`` entries. Pieces above a third of the capacity share a sequence with at most one other
such piece and are matched greedily, longest with the longest partner that fits; smaller pieces go,
longest first, to the smallest gap that holds them. The plan says which ranks within a length go to
which sequences, and the pieces find their place by a rank that is computed in parallel.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tiktoken import Encoding

from siftwell.llm.bpe import byte_level, special_ids
from siftwell.llm.common import map_texts, pinned
from siftwell.llm.pretokens import PATTERN, settled

CAPACITY = 2048
#: Pieces of one length that are numbered by one task.
RANKED_TOGETHER = 4000


class Run(NamedTuple):
    """Pieces of ``length`` with ranks from ``first``: ``each`` of them side by side at ``offset`` in every
    sequence from ``sequence`` on, ``n`` pieces in all."""

    length: int
    first: int
    n: int
    each: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Where the pieces of each length go. Steps depend on the number of lengths, not of pieces."""
    runs: list[Run] = []
    taken = dict.fromkeys(histogram, 0)
    left = {n: k for n, k in histogram.items() if k and 0 < n <= capacity}
    sequences = 0

    def place(length: int, n: int, each: int, sequence: int, offset: int) -> None:
        runs.append(Run(length, taken[length], n, each, sequence, offset))
        taken[length] += n
        left[length] -= n

    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, how many alike), by gap

    large = sorted(n for n in left if 3 * n > capacity)
    for long in reversed(large):
        while left[long]:
            at = bisect_left(large, capacity - long + 1) - 1
            # a last piece of its length is no partner of itself
            while at >= 0 and left[large[at]] <= (large[at] == long):
                at -= 1
            partner = large[at] if at >= 0 else None
            if partner is None:
                bins = left[long]
            elif partner == long:
                bins = left[long] // 2
            else:
                bins = min(left[long], left[partner])
            place(long, bins, 1, sequences, 0)
            used = long
            if partner is not None:
                place(partner, bins, 1, sequences, long)
                used += partner
            if used < capacity:
                insort(gaps, (capacity - used, sequences, bins))
            sequences += bins

    for small in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[small]:
            at = bisect_left(gaps, (small, -1, -1))
            if at == len(gaps):
                each = capacity // small
                bins = -(-left[small] // each)
                insort(gaps, (capacity, sequences, bins))
                sequences += bins
                continue
            gap, first, alike = gaps.pop(at)
            each = min(gap // small, left[small])
            bins = min(alike, left[small] // each)
            place(small, bins * each, each, first, capacity - gap)
            if gap > each * small:
                insort(gaps, (gap - each * small, first, bins))
            if bins < alike:
                insort(gaps, (gap, first + bins, alike - bins))
    return runs


class Ids:
    """Token ids of texts as little-endian 32-bit bytes.

    Two public libraries give the same ids for one vocabulary. The faster one encodes texts whose
    characters have the same class in all Unicode versions; the tokenizer file's own library the rest.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.path = path
        merges, special = byte_level(path)
        ids = special_ids(path)
        self.fast = Encoding(path, pat_str=PATTERN, mergeable_ranks={text: i for i, text in merges.spell.items()}, special_tokens={s: ids[s] for s in special})
        self._library = None

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def of(self, text: str) -> bytes:
        if settled(text):
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False).tobytes()
        return array("I", self.library().encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens; only the first can be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n > capacity else [(0, n)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document: ``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids``."""
    end = array("I", [end_id]).tobytes()

    def worker():
        of = ids_of(path).of

        def work(texts: list[str]):
            rows = []
            for at, text in enumerate(texts):
                raw = of(text) + end
                for k, (start, n) in enumerate(cut(len(raw) // 4, capacity)):
                    own = raw[4 * start : 4 * (start + n)]
                    rows.append((at, k, start, n, zlib.crc32(own), array("I", own).tolist() if with_ids else None))
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(6)]
            return columns[0], columns[1 : 6 if with_ids else 5]

        return work

    schema = "piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return map_texts(docs, id_col, text_col, schema, worker)


def ranked(items: DataFrame) -> DataFrame:
    """``items`` with ``rank``: 0, 1, 2, ... within each length, in any order, without one task per length."""
    n = items.count()
    buckets = max(16, -(-n // RANKED_TOGETHER))
    spread = items.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    sizes = spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row"))
    return spread.withColumn("own", own).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("own") - 1 + F.col("before"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    Each document is its token ids and then ``end_id``; only a document longer than ``capacity`` is
    cut. A null or empty text is the end id alone. Null ids are kept; rows that repeat an id are
    packed as documents of their own; an empty table gives an empty result. Columns other than id
    and text are not looked at.
    """
    items = pinned(pieces(docs, path, capacity, end_id, id_col, text_col, with_ids).withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = docs.sparkSession.createDataFrame(plan(histogram, capacity), "length long, first long, n long, each long, sequence long, place long")
    at = F.col("rank") - F.col("first")
    placed = ranked(items).join(F.broadcast(runs), "length").where((at >= 0) & (at < F.col("n")))
    out = placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("place") + (at % F.col("each")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids`` from :func:`pack` with ids; a sequence holds at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids")
    )
