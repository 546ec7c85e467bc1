"""SimHash near-duplicates through multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within the distance agree closely in some
segment, so looking up the small Hamming ball around each segment value finds every such pair;
candidates are verified by the distance of the whole fingerprints. Equal fingerprints are merged
first. A segment value that very many fingerprints share is not joined pair by pair: its members are
linked to each other inside the bucket and only a spanning forest leaves it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import map_texts, pinned, prepare
from siftwell.llm.graph import components

#: Buckets of more fingerprints are linked inside.
HOT = 48
#: Hot buckets of more fingerprints are first split by the remaining bits.
LARGE = 4096
#: Fingerprints shared by more than this share of rows are joined back by broadcast: at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.0005
#: With more distinct fingerprints the segments are widened, to keep buckets small.
MANY = 1 << 23
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles of ``text``; 0 without a word."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return int(np.uint64(xxh64_intdigest(line, seed)).astype(np.int64))
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    hashes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        own = hashes[part : part + (1 << 16)]
        ones += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row."""
    return map_texts(docs, id_col, text_col, "fp long", lambda: lambda texts: (None, [[fingerprint(t, width) for t in texts]]))


def segments(count: int, distance: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment: some segment of any two near fingerprints is within its radius."""
    r, rest = divmod(distance, count)
    cuts = [64 * i // count for i in range(count + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i], r if i <= rest else r - 1) for i in range(count)]


def ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def _value(shift: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))


def _table(fps: DataFrame, cut: list[tuple[int, int, int]]) -> DataFrame:
    """``seg, key, fp``: each fingerprint under each of its segment values."""
    rows = F.array(*[F.struct(F.lit(i).alias("seg"), _value(s, w).alias("key")) for i, (s, w, r) in enumerate(cut) if r >= 0])
    return fps.select("fp", F.explode(rows).alias("x")).select("x.seg", "x.key", "fp")


def _ball_of(value: Column, seg: int, width: int, radius: int) -> Column:
    """Array of ``seg, key`` for the ball around ``value``."""
    keys = F.transform(F.lit(ball(width, radius)).cast("array<bigint>"), lambda mask: value.bitwiseXOR(mask))
    if radius == 1:  # of two values that differ in one bit, the one without it finds the other
        keys = F.filter(keys, lambda key: key.bitwiseAND(value) == value)
    return F.transform(keys, lambda key: F.struct(F.lit(seg).alias("seg"), key.alias("key")))


def _probes(fps: DataFrame, cut: list[tuple[int, int, int]]) -> DataFrame:
    """``seg, key, fp``: each fingerprint under every value in the ball around its segment values."""
    parts = [_ball_of(_value(s, w), i, w, r) for i, (s, w, r) in enumerate(cut) if r >= 0]
    return fps.select("fp", F.explode(F.concat(*parts)).alias("x")).select("x.seg", "x.key", "fp")


def link_bucket(members: np.ndarray, others: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (member, other) within the distance."""
    nodes, where = np.unique(np.concatenate([members, others]), return_inverse=True)
    m, o = where[: len(members)], where[len(members) :]
    parent = np.arange(len(nodes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    bits, edges = nodes.view(np.uint64), []
    step = max(1, 2_000_000 // max(1, len(o)))
    for at in range(0, len(m), step):
        own = m[at : at + step]
        near = np.bitwise_count(bits[own][:, None] ^ bits[o][None, :]) <= distance
        for k, row in enumerate(near):
            hits = o[row]
            if not len(hits):
                continue
            tops = {root(x) for x in np.unique(parent[hits]).tolist()} | {root(int(own[k]))}
            low = min(tops)
            for t in tops:
                if t != low:
                    parent[t] = low
                    edges.append((int(nodes[low]), int(nodes[t])))
            parent[hits] = low
            parent[own[k]] = low
    return edges


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """``a, b``: edges that join exactly the fingerprints connected by steps of at most ``distance`` bits."""
    cut = segments(3 if fps.count() <= MANY else 2, distance)
    table, probes = _table(fps, cut), _probes(fps, cut)
    sizes = table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    hot = pinned(sizes)

    far = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp")))
    cold_table = table.join(hot, ["seg", "key"], "left_anti")
    same = (F.col("p.seg") == F.col("t.seg")) & (F.col("p.key") == F.col("t.key"))
    cold = probes.alias("p").join(cold_table.alias("t"), same & (F.col("p.fp") != F.col("t.fp")) & (far <= distance))
    cold = cold.select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b"))
    if hot.isEmpty():
        return cold

    both = table.withColumn("member", F.lit(True)).unionByName(probes.withColumn("member", F.lit(False))).join(hot, ["seg", "key"])
    # a large bucket is split once more: of distance + 1 parts of the whole fingerprint, one is equal in any near pair
    parts = segments(distance + 1, 0)
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("value")))
    split = F.array(*[F.struct(F.lit(i).alias("part"), _value(s, w).alias("value")) for i, (s, w, _) in enumerate(parts)])
    both = both.select("seg", "key", "fp", "member", F.explode(F.when(F.col("n") > LARGE, split).otherwise(whole)).alias("x"))

    def link(group: pd.DataFrame) -> pd.DataFrame:
        fp, member = group["fp"].to_numpy(np.int64), group["member"].to_numpy(bool)
        return pd.DataFrame(link_bucket(fp[member], np.unique(fp), distance), columns=["a", "b"], dtype=np.int64)

    inside = both.groupBy("seg", "key", "x.part", "x.value").applyInPandas(link, "a long, b long")
    return cold.unionByName(inside)


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    Rows whose fingerprints differ in at most ``distance`` bits are linked; ``component_id`` is the
    smallest id that a row reaches, its own included. Texts without a word, null ones among them,
    have fingerprint zero and are linked like any other. Null ids are passed over when the smallest
    is taken, so a component of null ids alone has a null id. Repeated rows are linked and each
    returned; an empty table gives an empty result; other columns are not looked at.
    """
    prepare(docs.sparkSession)
    own = pinned(fingerprints(docs, width, id_col, text_col))
    fps = pinned(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(fps.select("fp"), distance))
    with_root = fps.join(roots, fps["fp"] == roots["node"], "left").select(fps["fp"], "first", "n", F.coalesce("root", fps["fp"]).alias("root"))
    lowest = with_root.groupBy("root").agg(F.min("first").alias("component_id"))
    named = pinned(with_root.join(lowest, "root").select("fp", "n", "component_id"))

    most = max(1, own.count() * HOT_SHARE)
    frequent = named.where(F.col("n") > most).drop("n")
    marked = own.join(F.broadcast(frequent.select("fp", "component_id", F.lit(True).alias("hot"))), "fp", "left")
    rest = marked.where("hot is null").select("doc_id", "fp").join(named.where(F.col("n") <= most).select("fp", "component_id"), "fp")
    every = marked.where("hot").select("doc_id", "fp", "component_id").unionByName(rest.select("doc_id", "fp", "component_id"))
    return every.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_near(docs: DataFrame, distance: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that of the smallest id; all columns stay.

    Documents without an id have no smallest; they stay. Of rows that repeat an id all or none stay.
    """
    found = near_duplicates(docs, distance, width, id_col, text_col)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
