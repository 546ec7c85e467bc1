"""Fuzzy line deduplication by MinHash.

A line's character shingles give a signature; bands of it bring lines together that may be alike.
Candidates are verified by the exact Jaccard similarity of their shingle sets, links are joined to
components by distributed union-find, and the first line of each component stays. Equal lines are
compared once. What is shuffled for the bands is 16 bytes a band and line, packed by bucket. Of lines that
share a band only counts of their shingles by bins travel to it, which bound the similarity from above; the
lines themselves travel if that bound reaches the least similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siftwell.llm.common import pinned, prepare, stored, text_of
from siftwell.llm.graph import components

#: Characters of a shingle, least similarity of a link.
SHINGLE, LEAST = 5, 0.8
#: Bands of signature values: a pair at LEAST shares a band with probability 1 - (1 - 0.8**5)**18 > 0.999.
BANDS, ROWS = 18, 5
#: The lowest bits of a key name its band.
BAND_BITS = 5
#: Bands are looked into in rounds, up to these: what one round has joined the next need not verify.
ROUNDS = (1, 4, BANDS)
#: Buckets of more lines are linked inside a task instead of pair by pair; past TILE lines, by pairs of tiles.
HOT, TILE = 32, 4000
#: Characters whose signatures are computed together, and band entries that are held at once.
SWEEP, HELD = 1 << 16, 1 << 20
#: Rows of small buckets that are paired together.
TOGETHER = 1 << 12
#: Shingles of a line are counted in BINS by their hash, up to MOST a bin; pairs whose bounds are looked into at once.
BINS, MOST, BOUNDED = 128, 255, 1 << 13
#: Bits of a line's shingles in a bucket that is linked inside a task; lines that a line is held against at first, and at most, at once.
BITS, FEW, MANY = 1024, 64, 1 << 14
#: Bits of the filter that says which lines may be candidates: at least 16 a candidate, and at most 2**MOST_BITS.
MOST_BITS = 29
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors: multiplied by one, hashes of 32 bits are another permutation.
_SEEDS = np.array([pow(0x9E3779B1, i + 1, 1 << 32) | 1 for i in range(BANDS * ROWS)], np.uint32)
_SPACE = " \t\n\x0b\x0c\r"
_entry = np.dtype([("key", "<i8"), ("h", "<i8")])


def shingles(line: str) -> set[str]:
    """Distinct character shingles of ``line``; a shorter line is one shingle."""
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def _different(lines: list[str]) -> np.ndarray:
    """Distinct ``number of the line << 48 | hash of a shingle``, in order."""
    h, n = _hashed(lines)
    keys = (np.repeat(np.arange(len(lines), dtype=np.uint64), n) << np.uint64(48)) | (h >> np.uint64(16))
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def similarities(a: list[str], b: list[str]) -> np.ndarray:
    """Jaccard similarity of the shingle sets of each of ``a`` and of ``b``, at most 2**16 of them."""
    one, two = _different(a), _different(b)
    both = np.concatenate([one, two])
    both.sort(kind="stable")
    n = [np.bincount((x >> np.uint64(48)).astype(np.int64), minlength=len(a)) for x in (one, two, both[1:][both[1:] == both[:-1]])]
    return n[2] / (n[0] + n[1] - n[2])


def binned(lines: list[str]) -> np.ndarray:
    """``(lines, BINS)``: how many different shingles of each of ``lines`` fall into each bin."""
    parts, at, size = [np.empty((0, BINS), np.uint8)], 0, 0
    for i, line in enumerate([*lines, ""]):
        if i > at and (size + len(line) > SWEEP or i == len(lines)):
            keys = _different(lines[at:i])
            places = (keys >> np.uint64(48)).astype(np.int64) * BINS + (keys & np.uint64(BINS - 1)).astype(np.int64)
            parts.append(np.minimum(np.bincount(places, minlength=(i - at) * BINS), MOST).astype(np.uint8).reshape(-1, BINS))
            at, size = i, 0
        size += len(line)
    return np.concatenate(parts)


def may_be_similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether lines of bins ``a`` and ``b`` can have a similarity of LEAST: two lines share at most the lesser count of each bin.

    A bin that is full in both has no bound, and so such a pair passes.
    """
    low = np.minimum(a, b)
    both = low.sum(axis=1, dtype=np.int64)
    either = a.sum(axis=1, dtype=np.int64) + b.sum(axis=1, dtype=np.int64) - both
    return (both >= LEAST * either - 1e-6) | (low == MOST).any(axis=1)


def bands(lines: list[str]) -> np.ndarray:
    """Keys (lines, BANDS) of the MinHash signatures of all ``lines``, none of them empty."""
    parts, at, size = [], 0, 0
    for i, line in enumerate(lines):
        if size + len(line) > SWEEP and i > at:
            parts.append(_bands(lines[at:i]))
            at, size = i, 0
        size += len(line)
    parts.append(_bands(lines[at:]) if at < len(lines) else np.empty((0, BANDS), np.int64))
    return np.concatenate(parts)


def _hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all ``lines``, repeated ones too, one line behind the other, and how many each line has."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters to the end of the line
    padded = np.concatenate([points.astype(np.uint64) + np.uint64(1), np.zeros(SHINGLE, np.uint64)])
    h = np.zeros(len(points), np.uint64)
    for k in range(SHINGLE):
        h ^= h >> np.uint64(29)
        h *= _MULTIPLY
        h += padded[k : k + len(points)] * (left > k)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    # a shingle lies in its line; a line shorter than one is one shingle
    whole = (left >= SHINGLE) | (left == np.repeat(sizes, sizes))
    return h[whole], np.maximum(sizes - SHINGLE + 1, 1)


def _bands(lines: list[str]) -> np.ndarray:
    h, n = _hashed(lines)
    small, first = (h >> np.uint64(32)).astype(np.uint32), np.cumsum(n) - n
    keys, mixed = np.zeros((BANDS, len(lines)), np.uint64), np.empty_like(small)
    for i, seed in enumerate(_SEEDS):
        np.multiply(small, seed, out=mixed)
        low = np.minimum.reduceat(mixed, first).astype(np.uint64)
        band = i // ROWS
        keys[band] = (keys[band] ^ (keys[band] >> np.uint64(31))) * _MULTIPLY + low + np.uint64(1)
    keys = (keys ^ (keys >> np.uint64(29))) * _MULTIPLY
    keys = keys >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS)
    return (keys + np.arange(BANDS, dtype=np.uint64)[:, None]).T.copy().view(np.int64)


def _with_words(text: str) -> list[str]:
    return [line for line in text.split("\n") if line.strip(_SPACE)]


def _hash(line: str) -> int:
    """Spark's ``xxhash64`` of a string, unsigned."""
    return xxh64_intdigest(line.encode(), 42)


def _packed_bands(buckets: int):
    """Texts to rows ``bucket, entries``: the band keys and hashes of their different lines, packed by bucket of the key."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            entries = np.concatenate(held)
            bucket = (entries["key"].view(np.uint64) >> np.uint64(BAND_BITS)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            entries, bucket = entries[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            rows = [entries[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            held.clear()
            return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cut[:-1]].astype(np.int32)), "entries": pa.array(rows, pa.binary())})

        for batch in batches:
            fresh: dict[int, str] = {}
            for text in batch.column(0).to_pylist():
                for line in _with_words(text):
                    h = _hash(line)
                    if h not in seen:
                        seen.add(h)
                        fresh[h] = line
            if fresh:
                entries = np.empty((len(fresh), BANDS), _entry)
                entries["key"] = bands(list(fresh.values()))
                entries["h"] = np.fromiter(fresh, np.uint64, len(fresh)).view(np.int64)[:, None]
                held.append(entries.reshape(-1))
            if sum(map(len, held)) >= HELD:
                yield out()
            if len(seen) > HELD:  # a line that comes again later is packed again
                seen.clear()
        if held:
            yield out()

    return pack


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_packed_bands`, sorted by bucket, to ``key, h`` of the keys that several lines have.

    Of a bucket only one hash for each key is remembered, so a key of very many lines streams through.
    """

    def passed(known: np.ndarray, done: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known keys with a hash each and whether it was passed on, brought up to date, and what passes now."""
        new = new[np.lexsort((new["h"], new["key"]))]
        new = new[np.concatenate([[True], (new["key"][1:] != new["key"][:-1]) | (new["h"][1:] != new["h"][:-1])])]
        both = np.concatenate([known, new])
        old = np.concatenate([np.ones(len(known), bool), np.zeros(len(new), bool)])
        done = np.concatenate([done, np.zeros(len(new), bool)])
        order = np.lexsort((~old, both["key"]))
        both, old, done = both[order], old[order], done[order]
        first = np.concatenate([[True], both["key"][1:] != both["key"][:-1]])
        group = np.cumsum(first) - 1
        head = np.flatnonzero(first)
        several = np.bincount(group, both["h"] != both["h"][head][group]) > 0
        out = (several[group] | done[head][group]) & ~done & (~old | several[group])
        return both[head], done[head] | several, both[out]

    bucket, known, done, held, rows = None, np.empty(0, _entry), np.empty(0, bool), [], 0

    def record(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": pa.array(found["key"].copy()), "h": pa.array(found["h"].copy())})

    for batch in batches:
        for b, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (b != bucket or rows >= HELD) and held:
                known, done, found = passed(known, done, np.concatenate(held))
                held, rows = [], 0
                yield record(found)
            if b != bucket:
                bucket, known, done = b, np.empty(0, _entry), np.empty(0, bool)
            held.append(np.frombuffer(entries, _entry))
            rows += len(held[-1])
    if held:
        yield record(passed(known, done, np.concatenate(held))[2])


def similar(a: set[str], b: set[str]) -> bool:
    if min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= LEAST * (len(a) + len(b) - both)


def link_lines(nodes: list, lines: list[str], roots: list) -> list[tuple]:
    """Edges that, with those of equal ``roots``, join what the similar lines among ``lines`` would join.

    A line is held against shorter ones of other components, those of about its length first, many at once: by a
    bound from bits of their shingles, and if that reaches LEAST by the exact number of common shingles.
    """
    different = [_different([line]) for line in lines]
    sizes = np.fromiter(map(len, different), np.int64, len(lines))
    order = np.lexsort((np.unique(np.array(nodes, object), return_inverse=True)[1], sizes))
    sizes = sizes[order]
    names, ids = np.unique(np.concatenate([different[i] for i in order]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    bits = _bits(names, ids, sizes)
    n_bits = np.bitwise_count(bits).sum(axis=0, dtype=np.int64)
    heads: dict = {}
    group = np.array([heads.setdefault(roots[i], at) for at, i in enumerate(order.tolist())])
    own, edges = np.zeros(len(names), np.int32), []
    for at in range(1, len(order)):
        low, high, step = int(np.searchsorted(sizes, LEAST * sizes[at] - 1e-6)), at, FEW
        mine = ids[starts[at] : starts[at] + sizes[at]]
        own[mine] = 1
        while high > low:
            first, step = max(low, high - step), min(4 * step, MANY)
            j, high = np.arange(first, high), first
            others = group[j] != group[at]
            if not others.any():
                continue
            # a bit that one line alone has is a shingle that the other lacks
            shared = np.bitwise_count(bits[:, j[0] : j[-1] + 1] & bits[:, at, None]).sum(axis=0, dtype=np.uint16)
            most = np.minimum(sizes[at] - n_bits[at], sizes[j] - n_bits[j]) + shared
            j = j[others & (most >= LEAST * (sizes[at] + sizes[j] - most) - 1e-6)][::-1]
            while len(j):
                # as many at once as have about SWEEP shingles
                n = max(1, int(np.searchsorted(np.cumsum(sizes[j]), SWEEP)))
                part, j = j[:n], j[n:]
                theirs = np.concatenate([ids[a:z] for a, z in zip(starts[part].tolist(), (starts[part] + sizes[part]).tolist(), strict=True)])
                both = np.add.reduceat(own[theirs], np.cumsum(sizes[part]) - sizes[part])
                for k in part[both >= LEAST * (sizes[at] + sizes[part] - both)].tolist():
                    if group[k] != group[at]:
                        edges.append((nodes[order[at]], nodes[order[k]]))
                        group[group == group[at]] = group[k]
                j = j[group[j] != group[at]]
        own[mine] = 0
    return edges


def _bits(names: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``(BITS / 64, lines)``: bits of the shingles ``ids``, places in their hashes ``names``, of lines of ``sizes``."""
    place = np.repeat(np.arange(len(sizes)) * BITS, sizes) + (names & np.uint64(BITS - 1)).astype(np.int64)[ids]
    flags = np.zeros(len(sizes) * BITS, bool)
    flags[place] = True
    return np.packbits(flags.reshape(len(sizes), BITS), axis=1).view(np.uint64).T.copy()


def _edges(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})


def _link_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, s, t, node, root, line``, sorted by the first three, to the edges of each group of them."""
    at, nodes, lines, roots = None, [], [], []
    for batch in batches:
        found = []
        for key, s, t, node, root, line in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (key, s, t) != at:
                found += link_lines(nodes, lines, roots) if len(nodes) > 1 else []
                at, nodes, lines, roots = (key, s, t), [], [], []
            nodes.append(node)
            roots.append(root)
            lines.append(line)
        yield _edges(found)
    yield _edges(link_lines(nodes, lines, roots) if len(nodes) > 1 else [])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``a, b, line_a, line_b`` to the pairs that are similar."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            a, b, line_a, line_b = [c.to_pylist() for c in batch.slice(at, 256).columns]
            yield _edges([(a[i], b[i]) for i in np.flatnonzero(similarities(line_a, line_b) >= LEAST).tolist()])


def _line_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, ord, k, line_no, line, node`` of every line; ``node``, its digest, is null for a line without a word."""
    text = text_of(docs, text_col)
    own = docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(docs[id_col].try_cast("long"), F.lit((1 << 63) - 1)).alias("ord"),
        F.xxhash64(docs[id_col], text).alias("k"),
        F.posexplode(F.split(text, "\n")).alias("line_no", "line"),
    )
    return own.withColumn("node", F.when(F.trim("line", F.lit(_SPACE)) != "", _digest(F.col("line"))))


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _filter_of(hashes: DataFrame) -> np.ndarray:
    """Bits that are set for all ``hashes (h)``; the number of bits has a fixed bound, so more hashes only make it coarser."""
    bits = min(MOST_BITS, max(16, (16 * hashes.count()).bit_length()))
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.groupBy(F.shiftright(place, 5).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 31 AS INT)))").alias("word"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    found = words.toArrow()
    out[found["at"].to_numpy()] = found["word"].to_numpy().astype(np.uint32)
    return out


def _candidate_lines(shared):
    """Texts to ``h, node, line`` of their lines that pass the filter."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        for batch in batches:
            lines = list({line for text in batch.column(0).to_pylist() for line in _with_words(text)})
            h = np.fromiter(map(_hash, lines), np.uint64, len(lines))
            hit = _passing(shared.value, h)
            some = [lines[i] for i in hit.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), pa.array([md5(x.encode()).digest() for x in some], pa.binary()), pa.array(some, pa.string())], names=["h", "node", "line"])

    return choose


def _with_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``h, node, line`` to ``h, node, line, bins``."""
    for batch in batches:
        bins = pa.array([row.tobytes() for row in binned(batch.column(2).to_pylist())], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, bins], names=["h", "node", "line", "bins"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, node, root, bins``, sorted by key and node, to the pairs of a key that have different roots and may be similar."""
    held: pa.Table | None = None

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        keys, nodes = rows["key"].to_numpy(), rows["node"].to_pylist()
        roots = np.frombuffer(b"".join(rows["root"].to_pylist()), np.uint64).reshape(len(nodes), -1)
        bins = np.frombuffer(b"".join(rows["bins"].to_pylist()), np.uint8).reshape(-1, BINS)
        found = []
        for step in range(1, len(nodes)):
            i = np.flatnonzero(keys[step:] == keys[:-step])
            if not len(i):
                break
            i = i[(roots[i] != roots[i + step]).any(axis=1)]
            for at in range(0, len(i), BOUNDED):
                own = i[at : at + BOUNDED]
                found += [(nodes[k], nodes[k + step]) for k in own[may_be_similar(bins[own], bins[own + step])].tolist()]
        return _edges(found)

    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        keys = held["key"].to_numpy()
        whole = int(np.flatnonzero(keys == keys[-1])[0])  # the last key may go on in the next batch
        if whole >= TOGETHER:
            yield pairs(held.slice(0, whole))
            held = held.slice(whole)
    if held is not None:
        yield pairs(held)


def _passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes ``h`` (uint64) that are set in the filter."""
    place = h & np.uint64(32 * len(bits) - 1)
    return np.flatnonzero((bits[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1))


def _lines_of(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, line`` of ``nodes``, and of few others, so that not all lines travel to a join."""
    spark = known.sparkSession
    shared = spark.sparkContext.broadcast(_filter_of(nodes.select(F.xxhash64("node").alias("h"))))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(_passing(shared.value, batch.column(0).to_numpy().view(np.uint64)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(hit), batch.column(2).take(hit)], names=["node", "line"])

    return known.select(F.xxhash64("node"), "node", "line").mapInArrow(choose, "node binary, line string")


def _linked(members: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """``a, b`` for ``members (key, node, root)``: similar lines with a common key, as far as their roots differ."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    shared = pinned(members.join(sizes.select("key", "n"), "key"))
    # each pair of a small bucket is verified once, in however many buckets it meets
    cold = shared.where(F.col("n") <= HOT).join(known.select("node", "bins"), "node").select("key", "node", "root", "bins")
    pairs = pinned(cold.repartition(width, "key").sortWithinPartitions("key", "node").mapInArrow(_close, "a binary, b binary").distinct())
    some = _lines_of(known, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    lines = [some.select(F.col("node").alias(x), F.col("line").alias(f"line_{x}")) for x in ("a", "b")]
    both = pairs.join(lines[1], "b").join(lines[0], "a").select("a", "b", "line_a", "line_b")
    links = pinned(both.mapInArrow(_verify, "a binary, b binary"))
    if shared.where(F.col("n") > HOT).isEmpty():
        return links

    tiles = F.ceil(F.col("n") / TILE)
    own = F.pmod(F.xxhash64("node"), tiles)
    meet = F.transform(F.sequence(F.lit(0).cast("long"), tiles - 1), lambda t: F.struct(F.least(t, own).alias("s"), F.greatest(t, own).alias("t")))
    spread = shared.where(F.col("n") > HOT).select("key", "node", "root", F.explode(F.array_distinct(meet)).alias("tile")).join(known.select("node", "line"), "node")
    groups = spread.select("key", "tile.s", "tile.t", "node", "root", "line").repartition(width, "key", "s", "t").sortWithinPartitions("key", "s", "t")
    return links.unionByName(groups.mapInArrow(_link_sorted, "a binary, b binary"))


def line_roots(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``node, root`` of every line that is similar to another, by digest.

    The first bands join most of what belongs together; of the other bands only keys whose lines lie in
    different components are looked into.
    """
    texts = docs.select(text_of(docs, text_col).alias("text"))
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # no step of this chain is named, so that its shuffle files can go once the result is pinned
    shared = pinned(
        texts.mapInArrow(_packed_bands(4 * width), "bucket int, entries binary")
        .repartition(width, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_shared, "key long, h long")
        .distinct()
    )
    hashes = pinned(shared.select("h").distinct())
    bits = spark.sparkContext.broadcast(_filter_of(hashes))
    known = stored(
        texts.mapInArrow(_candidate_lines(bits), "h long, node binary, line string")
        .groupBy("node")
        .agg(F.first("h").alias("h"), F.first("line").alias("line"))
        .join(hashes, "h", "left_semi")
        .select("h", "node", "line")
        .mapInArrow(_with_bins, "h long, node binary, line string, bins binary")
    )

    band = F.col("key").bitwiseAND(F.lit((1 << BAND_BITS) - 1))
    members = pinned(shared.join(known.select("h", "node"), "h").select("key", "node"))
    roots = components(_linked(members.where(band == 0).withColumn("root", F.col("node")), known, width))
    for low, high in zip(ROUNDS[:-1], ROUNDS[1:], strict=True):
        found = pinned(roots.withColumnRenamed("node", "n"))
        own = members.where((band >= low) & (band < high)).join(found, F.col("node") == F.col("n"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        edges = _linked(own, known, width)
        roots = components(found.select(F.col("n").alias("a"), F.col("root").alias("b")).unionByName(edges))
    return roots


def fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: ``doc_id, line_no`` (from 0), ``component`` and ``kept``.

    Lines are cut at newlines. Of a component, lines joined by steps of similarity 0.8 or more over
    five-character shingles, the first line stays, by id (null last) and line number; ``component`` is
    a 128-bit digest in hexadecimal. Lines without a word belong to no component and stay; a null or
    empty text is one such line. Lines shorter than a shingle are compared as wholes. Rows that repeat
    an id with the same text are one document. An empty table gives an empty result; other columns are
    not looked at.
    """
    prepare(docs.sparkSession)
    roots = line_roots(docs, text_col)
    places = _line_columns(docs, id_col, text_col).drop("line")
    place = F.struct("ord", "k", "line_no")
    firsts = places.where("node is not null").groupBy("node").agg(F.min(place).alias("first"))
    named = firsts.join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").select("node", "root", "first")
    named = pinned(named)
    # of a component of several different lines only the first place stays
    best = named.where("root is not null").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first").alias("best"))
    alone = named.where("root is null").select("node", F.col("node").alias("component"), "first")
    alike = named.where("root is not null").join(best, F.col("first") == F.col("best"), "left").select("node", F.col("root").alias("component"), F.col("best").alias("first"))
    table = alone.unionByName(alike).withColumnRenamed("node", "n")
    marked = places.join(table, F.col("node") == F.col("n"), "left")
    kept = F.col("node").isNull() | F.coalesce(F.col("first") == place, F.lit(False))
    return marked.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.lower(F.hex("component")).alias("component"), kept.alias("kept"))
