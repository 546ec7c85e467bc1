"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is coded as its words and an end mark, every one of them by binary decisions. A token with a
share of at least 1 / ``SHARE`` of the training tokens is a leaf of a Huffman tree, and the decisions
are the turns on the way to it; any other token takes the turns to an escape leaf and is then spelt,
every byte as eight decisions, with a space behind it. For each decision several predictors look up
how often 0 and 1 followed the same hashed context: for turns, the words before and their endings;
for bytes, the bytes before in the word. Their log-odds are added up with weights that a gate picks
by how often each context was seen. Weights are learned online, an occurrence's own contribution
left out, and an adaptive map refines the mixed probability. Scoring freezes the model, so a text's
score does not depend on which others are scored.

Beside it stands a smoothed unigram model, for which token counts are joined exactly. How words are
spelt does not depend on their neighbours, so it is computed once for each different word.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import map_texts, pinned, prepare, text_of

#: Tokens with a share of at least 1 / SHARE of the training tokens have a leaf; so there are at most SHARE.
SHARE = 1 << 20
#: Slots of a context table: one for some eight training tokens, up to 2**MOST_BITS, which every worker can hold.
LEAST_BITS, MOST_BITS = 14, 21
#: The most frequent tokens; which of them came last tells the kind of text.
GUIDES = 64
#: Byte contexts of 0..ORDERS-1 bytes, and the word so far as long as it is short.
ORDERS, SO_FAR = 6, 32
#: Predictors of turns and of bytes, and which of them picks the set of weights.
TURN_TABLES, TURN_LEAD, BYTE_TABLES, BYTE_LEAD = 5, 2, ORDERS + 1, ORDERS
#: Slots of a table that travel as one row.
BLOCK = 1 << 13
#: Gates by how often a context was seen: 0, 1, 2-3, 4-7, 8-15, 16-63, 64-511, more.
GATES = 8
_GATE_FROM = np.array([1, 2, 4, 8, 16, 64, 512])
#: Steps in which a frozen model keeps log-odds, finer near zero.
ODDS = 64
#: Steps of the adaptive map over the mixed log-odds, which run from -12 to 12.
STEPS = 48
#: All training texts, and all different words, teach the weights, in fixed shards of some so many tokens, so that the
#: weights do not depend on partitions.
SHARD_TOKENS = 1 << 22
#: Tokens, or bytes of words, whose decisions are looked into together.
SWEEP = 1 << 12
#: Decisions of one online step.
STRIDE = 8192
#: Rows of a shard that are learned from together.
TOGETHER = 256
#: Distinct tokens that a worker counts before it hands them on.
COUNTED = 300_000
END = b"\n"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LN10 = float(np.log(10.0))
_K = [np.uint32(k) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(LOWER).split()


class Decisions(NamedTuple):
    """Binary decisions: slots by table, bits, the kind 0..7 of each; tokens they belong to, and the first decision of each token."""

    slots: list[np.ndarray]
    bits: np.ndarray
    kind: np.ndarray
    owner: np.ndarray
    first: np.ndarray


def _spread(x: np.ndarray) -> np.ndarray:
    """All bits of ``x`` (uint32) made to depend on each other."""
    x = x ^ (x >> np.uint32(16))
    x *= _K[1]
    x ^= x >> np.uint32(13)
    x *= _K[2]
    return x ^ (x >> np.uint32(16))


def _slots(contexts: list[np.ndarray], sizes: np.ndarray | int, node: np.ndarray, bits: int) -> list[np.ndarray]:
    """Slots of ``node`` after each of ``contexts``, which are given once for ``sizes`` nodes."""
    node, out = node * _K[0], []
    for c in contexts:
        s = np.repeat(c, sizes)
        s ^= node
        s *= _K[3]
        s >>= np.uint32(32 - bits)
        out.append(s.astype(np.intp))
    return out


class Tree:
    """Huffman tree over the frequent tokens, the end mark and the escape; ids are places by frequency."""

    def __init__(self, counts: dict[bytes, int], total: int):
        self.tokens = sorted({END, *counts}, key=lambda t: (-counts.get(t, 0), t))
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.escape = len(self.tokens)
        # a token that came once was not known before it came: as many others may be expected
        once = sum(k == 1 for k in counts.values())
        weights = [counts.get(t, 0) + 1 for t in self.tokens] + [max(1, total - sum(counts.values()) + once)]
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, at = np.zeros(2 * len(weights), np.int64), len(weights)
        side = np.zeros(2 * len(weights), bool)
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x] = parent[y] = at
            side[y] = True
            heapq.heappush(heap, (a + b, at))
            at += 1
        root, nodes, bits, sizes = at - 1, [], [], []
        for leaf in range(len(weights)):
            path, x = [], leaf
            while x != root:
                path.append(x)
                x = int(parent[x])
            path.reverse()
            nodes += [int(parent[x]) - len(weights) for x in path]
            bits += [bool(side[x]) for x in path]
            sizes.append(len(path))
        self.sizes = np.array(sizes, np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.nodes, self.bits = np.array(nodes, np.uint32), np.array(bits, bool)
        self.endings = np.array([*map(_ending, self.tokens), 0], np.uint32)
        self.single = np.array([counts.get(t, 0) == 1 for t in self.tokens] + [False])

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of all tokens of ``texts``, an end mark behind each: ids, endings, first place of each text; and the unlisted words."""
        flat: list[bytes] = []
        ends = []
        for text in texts:
            flat += words_of(text)
            flat.append(END)
            ends.append(len(flat))
        ids = np.fromiter(map(self.ids.get, flat, repeat(self.escape)), np.int64, len(flat))
        rare = np.flatnonzero(ids == self.escape)
        unlisted = [flat[i] for i in rare.tolist()]
        endings = self.endings[ids]
        endings[rare] = np.fromiter(map(_ending, unlisted), np.uint32, len(unlisted))
        return ids, endings, np.array([0, *ends[:-1]], np.int64)[: len(texts)], unlisted

    def contexts(self, ids: np.ndarray, endings: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """The contexts of the tokens of texts that begin at ``first``, one array for each table of turns."""
        n = len(ids)
        place = np.arange(n, dtype=np.int32)
        begin = np.repeat(first.astype(np.int32), np.diff(np.concatenate([first, [n]])))
        inside = place - begin
        none = np.uint32(self.escape + 1)

        def before(values: np.ndarray, steps: int) -> np.ndarray:
            out = np.full(n, none, np.uint32)
            out[steps:] = values[: n - steps]
            out[inside < steps] = none
            return out

        # the last guide before each token, and the one before that
        guide = np.maximum.accumulate(np.where((ids < GUIDES) & (ids != self.ids[END]), place, np.int32(-1)))
        last = np.concatenate([np.full(min(n, 1), -1, np.int32), guide[:-1]])
        last[last < begin] = -1
        again = np.where(last >= 0, last[last], -1)
        short = ids.astype(np.uint32)
        one, two = (np.where(x >= 0, short[x], none) for x in (last, again))
        p1, p2 = before(short, 1), before(short, 2)
        return [
            np.zeros(n, np.uint32),
            _spread(p1 * _K[4] + np.uint32(1)),
            _spread((p1 * _K[4] ^ p2) * _K[0] + np.uint32(2)),
            _spread((one * _K[4] ^ two) * _K[0] + np.uint32(3)),
            _spread((before(endings, 1) * _K[4] ^ before(endings, 2)) * _K[0] + np.uint32(4)),
        ]

    def turns(self, contexts: list[np.ndarray], leaves: np.ndarray, table_bits: int) -> Iterator[Decisions]:
        """The turns to ``leaves`` in their ``contexts``, SWEEP tokens at a time."""
        for at in range(0, len(leaves), SWEEP):
            own = leaves[at : at + SWEEP]
            sizes = self.sizes[own]
            first = np.cumsum(sizes) - sizes
            depth = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            turn = np.repeat(self.first[own], sizes) + depth
            slots = _slots([c[at : at + SWEEP] for c in contexts], sizes, self.nodes[turn], table_bits)
            yield Decisions(slots, self.bits[turn], np.minimum(depth, 7), np.arange(at, at + len(own)), first)


def _ending(word: bytes) -> int:
    return int.from_bytes(word[-3:], "little")


def byte_decisions(words: list[bytes], table_bits: int) -> Iterator[Decisions]:
    """Of all bytes of ``words`` (each with the space behind it), SWEEP bytes at a time; a longer word is cut."""
    held: list[tuple[int, int, bytes, int]] = []  # word, place of the first byte that counts, bytes with those before, how many before
    size = 0
    for i, w in enumerate(words):
        for a in range(0, len(w), SWEEP):
            part, back = w[a : a + SWEEP], min(a, ORDERS)
            if size + len(part) > SWEEP and held:
                yield _byte_decisions(held, table_bits)
                held, size = [], 0
            held.append((i, a, w[a - back : a] + part, back))
            size += len(part)
    if held:
        yield _byte_decisions(held, table_bits)


def _byte_decisions(held: list[tuple[int, int, bytes, int]], table_bits: int) -> Decisions:
    flat = np.frombuffer(b"".join(h[2] for h in held), np.uint8).astype(np.uint32)
    sizes = np.array([len(h[2]) for h in held])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = np.arange(len(flat)) - first
    back = np.repeat([h[3] for h in held], sizes)
    place = inside - back + np.repeat([h[1] for h in held], sizes)
    contexts, now = [], np.zeros(len(flat), np.uint32)
    for order in range(ORDERS):
        if order:
            before = np.zeros(len(flat), np.uint32)
            before[order:] = flat[:-order] + np.uint32(1)
            now = (now ^ np.where(place >= order, before, np.uint32(0))) * _K[3]
            now ^= now >> np.uint32(14)
        contexts.append(now + np.uint32(order))
    powers = np.multiply.accumulate(np.full(SO_FAR + 1, _K[4], np.uint32))
    terms = np.where(place < SO_FAR, (flat + np.uint32(1)) * powers[np.minimum(place, SO_FAR)], np.uint32(0))
    sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum(terms, dtype=np.uint32)])
    whole = np.where(place <= SO_FAR, sums[:-1] - sums[first], np.uint32(0))
    contexts.append((whole ^ np.minimum(place, SO_FAR + 1).astype(np.uint32)) * _K[0] + np.uint32(ORDERS))
    keep = inside >= back
    own, word = flat[keep], np.repeat([h[0] for h in held], sizes)[keep]
    k = np.arange(8, dtype=np.uint32)
    node = ((np.uint32(1) << k) | (own[:, None] >> (np.uint32(8) - k))).reshape(-1)
    bits = ((own[:, None] >> (np.uint32(7) - k)) & np.uint32(1)).astype(bool).reshape(-1)
    slots = _slots([_spread(c[keep]) for c in contexts], 8, node, table_bits)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    return Decisions(slots, bits, np.tile(np.arange(8), len(own)), word[first], 8 * first)


def log_odds(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of 1 and the gate, of counts (n0, n1) in the last axis."""
    odds = np.log(n[..., 1] + np.float32(0.4)) - np.log(n[..., 0] + np.float32(0.4))
    return odds.astype(np.float32), np.searchsorted(_GATE_FROM, n.sum(-1, dtype=np.int64), side="right")


#: Log-odds of the steps, as they are read back.
_ODDS = 8 * np.arctanh(np.clip((np.arange(ODDS) - (ODDS // 2 - 1)) / (ODDS // 2 - 1), -0.98, 0.98))
_ODDS32 = _ODDS.astype(np.float32)


def _codes(n: np.ndarray) -> np.ndarray:
    """Gate and log-odds, in ODDS steps, of counts (n0, n1) in the last axis, as one code."""
    odds, gate = log_odds(n)
    half = ODDS // 2 - 1
    return (gate * ODDS + np.rint(half + half * np.tanh(odds / 8)).astype(np.int64)).astype(np.uint16)


def left_out(counts: np.ndarray) -> np.ndarray:
    """``(tables, 2 * slots)``: the code of each context before the last 0 was counted, and before the last 1 was."""
    out = np.empty((*counts.shape[:2], 2), np.uint16)
    for i, table in enumerate(counts):
        for bit in (0, 1):
            n = table.copy()
            n[:, bit] -= n[:, bit] > 0
            out[i, :, bit] = _codes(n)
    return out.reshape(len(counts), -1)


def _step(z: np.ndarray) -> np.ndarray:
    return np.clip((z + 12) * (STEPS / 24), 0, STEPS - 1).astype(np.int64)


class Learner:
    """Gated weights, and the adaptive map, over the codes of all contexts (see :func:`left_out`).

    The gate is how often the leading context was seen, and how often the predictor's own was.
    """

    def __init__(self, codes: np.ndarray, lead: int):
        self.codes, self.lead, self.tables = codes, lead, len(codes)
        self.weights = np.full(GATES * self.tables * GATES, 1.2 / self.tables, np.float32)
        self.speed = np.full_like(self.weights, 1e-6)
        self.map = np.zeros((STEPS * 8, 2), np.int64)
        self.seen = 0

    def __call__(self, d: Decisions) -> None:
        """Online steps over ``d``; they shrink as a weight has moved."""
        for at in range(0, len(d.bits), STRIDE):
            part = slice(at, at + STRIDE)
            bits = d.bits[part]
            codes = np.stack([self.codes[i].take(2 * d.slots[i][part] + bits, mode="clip") for i in range(self.tables)])
            gate = (codes // np.uint16(ODDS)).astype(np.intp)
            o = _ODDS32.take(codes % np.uint16(ODDS))
            c = gate + GATES * (gate[self.lead] * self.tables + np.arange(self.tables)[:, None])
            z = (self.weights.take(c) * o).sum(axis=0)
            p = 1 / (1 + np.exp(-np.clip(z, -14, 14)))
            o *= bits - p
            grad = np.bincount(c.reshape(-1), o.reshape(-1), len(self.weights)).astype(np.float32) / len(bits)
            self.speed += grad * grad
            self.weights += 0.05 * grad / np.sqrt(self.speed)
            self.map += np.bincount((_step(z) * 8 + d.kind[part]) * 2 + bits, minlength=self.map.size).reshape(self.map.shape)
        self.seen += len(d.bits)


class Mixer:
    """A frozen model. Of each context its gate and its log-odds, in ODDS steps, make one code."""

    def __init__(self, counts: np.ndarray, lead: int, weights: np.ndarray, refine: np.ndarray):
        self.lead, self.tables = lead, len(counts)
        self.codes = np.empty(counts.shape[:2], np.uint16)
        for i in range(self.tables):
            self.codes[i] = _codes(counts[i])
        # what a predictor with a code adds, by the leading gate
        adds = weights.reshape(GATES, self.tables, GATES, 1) * _ODDS
        self.adds = adds.transpose(1, 0, 2, 3).reshape(self.tables, -1).astype(np.float32)
        centre = (np.arange(STEPS) + 0.5) * (24 / STEPS) - 12
        prior = 1 / (1 + np.exp(-centre[:, None]))
        refine = refine.reshape(STEPS, 8, 2)
        self.map = ((refine[..., 1] + 40 * prior) / (refine.sum(-1) + 40)).astype(np.float32).reshape(-1)

    def logs(self, d: Decisions) -> np.ndarray:
        """Natural logarithms of the probabilities of the decisions, summed by token."""
        codes = [table.take(slots, mode="clip") for table, slots in zip(self.codes, d.slots, strict=True)]
        lead = (codes[self.lead] // np.uint16(ODDS)).astype(np.intp) * (GATES * ODDS)
        z = np.zeros(len(d.bits), np.float32)
        for adds, code in zip(self.adds, codes, strict=True):
            z += adds.take(lead + code, mode="clip")
        np.clip(z, -14, 14, out=z)
        p = np.float32(0.8) / (1 + np.exp(-z)) + np.float32(0.2) * self.map.take(_step(z) * 8 + d.kind, mode="clip")
        return np.add.reduceat(np.log(np.where(d.bits, p, 1 - p)).astype(np.float64), d.first)


def token_table(docs: DataFrame) -> DataFrame:
    """``token binary, n long``: lower-cased words and end marks of ``docs (text)`` with their counts."""

    def count(batches):
        found: Counter = Counter()

        def out():
            return pa.RecordBatch.from_pydict({"token": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(words_of(text))
            found[END] += batch.num_rows
            if len(found) > COUNTED:
                yield out()
                found.clear()
        if found:
            yield out()

    return docs.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _context_counts(source: DataFrame, decisions: Callable, tables: int, table_bits: int) -> Counts:
    """Counts of all contexts of ``decisions(batch)``, which gives them with what each counts.

    Few tasks count much each, because every one hands on whole tables, in packed blocks. A pair of
    counts that does not fit 16 bits is scaled down together.
    """
    slots = 1 << table_bits

    def count(batches):
        own = np.zeros((tables, 2 * slots), np.uint32)
        for batch in batches:
            for d, times in decisions(batch):
                for i in range(tables):
                    np.add.at(own[i], 2 * d.slots[i] + d.bits, times)
        rows = own.reshape(-1, 2 * BLOCK)
        for at in np.flatnonzero(rows.any(axis=1)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([int(at)], pa.int64()), "counts": pa.array([_packed(rows[at])], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _unpacked(raw, np.uint32).astype(np.int64)
                sums[block] = sums[block] + own if block in sums else own
        for block, total in sums.items():
            pair = total.reshape(-1, 2)
            high = np.maximum(pair.max(axis=1, keepdims=True), 65535)
            small = np.ceil(pair * (65535 / high)).astype(np.uint16)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "counts": pa.array([_packed(small)], pa.binary())})

    shape = "block long, counts binary"
    tasks = source.sparkSession.sparkContext.defaultParallelism
    summed = source.coalesce(tasks).mapInArrow(count, shape).repartition("block").mapInArrow(add, shape)
    blocks: list[bytes | None] = [None] * (tables * slots // BLOCK)
    for row in summed.collect():  # tables * slots counts, whatever the corpus
        blocks[row["block"]] = bytes(row["counts"])
    return Counts(tables, slots, blocks)


class Counts(NamedTuple):
    """Counts of all contexts as they travel, in packed blocks; None where all are zero."""

    tables: int
    slots: int
    blocks: list[bytes | None]

    def whole(self) -> np.ndarray:
        """``(tables, slots, 2)``."""
        out = np.zeros((len(self.blocks), 2 * BLOCK), np.uint16)
        for row, raw in zip(out, self.blocks, strict=True):
            if raw is not None:
                row[:] = _unpacked(raw, np.uint16)
        return out.reshape(self.tables, self.slots, 2)


def _packed(row: np.ndarray) -> bytes:
    """Bytes of equal weight lie together, as most high ones are zero."""
    row = np.ascontiguousarray(row).reshape(-1)
    return pa.compress(np.ascontiguousarray(row.view(np.uint8).reshape(len(row), -1).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = pa.decompress(raw, decompressed_size=2 * BLOCK * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _weights(source: DataFrame, order: list[str], tokens: int, decisions: Callable, shared, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Gated weights and the adaptive map, learned from ``source`` in shards by the hash of ``order``, in the order of another hash.

    An order of the alphabet would leave the weights with what lies at its end. Which shards there are
    follows from the data alone, and what they learned is added up in their order.
    """
    shards = max(8, tokens // SHARD_TOKENS)
    shape = "shard long, seen long, weights binary, map binary"

    def learn(batches):
        held: pa.Table | None = None
        learner, at, codes = None, None, left_out(shared.value.whole())

        def done(rows: pa.Table) -> None:
            for d, _ in decisions(rows.drop_columns("shard").combine_chunks()):
                learner(d)

        def out():
            done(held)
            return pa.RecordBatch.from_pydict({"shard": pa.array([at], pa.int64()), "seen": pa.array([learner.seen], pa.int64()), "weights": pa.array([learner.weights.tobytes()], pa.binary()), "map": pa.array([learner.map.tobytes()], pa.binary())})

        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if shard[a] != at:
                    if learner is not None:
                        yield out()
                    held, learner, at = None, Learner(codes, lead), int(shard[a])
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                held = part if held is None else pa.concat_tables([held, part])
                while held.num_rows >= TOGETHER:  # the same rows together, however they arrive
                    done(held.slice(0, TOGETHER))
                    held = held.slice(TOGETHER)
        if learner is not None:
            yield out()

    spread = source.withColumn("shard", F.pmod(F.xxhash64(*order, F.lit(1)), F.lit(shards)))
    spread = spread.select("shard", *source.columns).repartition("shard").sortWithinPartitions("shard", F.xxhash64(*order, F.lit(2)), *order)
    tables = shared.value.tables
    weights, refine, total = np.zeros(GATES * tables * GATES), np.zeros((STEPS * 8, 2)), 0
    for row in sorted(spread.mapInArrow(learn, shape).collect(), key=lambda r: r["shard"]):  # a few kB from each shard
        weights += row["seen"] * np.frombuffer(row["weights"], np.float32)
        refine += np.frombuffer(row["map"], np.int64).reshape(-1, 2)
        total += row["seen"]
    return (weights / total if total else np.full_like(weights, 1.2 / tables)), refine


def bits_for(tokens: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, int(tokens).bit_length() - 3))


class Scorer:
    """Scores whole texts with a frozen mixer, but for the spelling of unlisted words."""

    def __init__(self, tree: Tree, counts: dict[bytes, int], mixer: Mixer, table_bits: int):
        self.tree, self.mixer, self.bits = tree, mixer, table_bits
        self.base = np.array([np.log10(counts.get(t, 0) + 0.5) for t in tree.tokens] + [0.0])

    def __call__(self, texts: list[str]):
        if not texts:
            return None, [[], [], [], []]
        ids, endings, first, unlisted = self.tree.ids_of(texts)
        logs = np.empty(len(ids))
        for d in self.tree.turns(self.tree.contexts(ids, endings, first), ids, self.bits):
            logs[d.owner] = self.mixer.logs(d)
        sizes = np.diff(np.concatenate([first, [len(ids)]]))
        score = np.add.reduceat(logs, first) / _LN10
        base = np.add.reduceat(self.base[ids], first)
        n_rare = np.add.reduceat((ids == self.tree.escape).astype(np.int64), first)
        rare, at = [], 0
        for n in n_rare.tolist():
            rare.append([{"token": t, "n": k} for t, k in Counter(unlisted[at : at + n]).items()])
            at += n
        return None, [sizes, score, base, rare]


def _spelt(tokens: DataFrame, shared, weights: np.ndarray, refine: np.ndarray, table_bits: int) -> DataFrame:
    """``token, n, spelt``: log10 of the probability of the spelling of each of ``tokens (token, n)``."""

    def spell(batches):
        mixer = Mixer(shared.value.whole(), BYTE_LEAD, weights, refine)
        for batch in batches:
            words = [t + b" " for t in batch.column(0).to_pylist()]
            logs = np.zeros(len(words))
            for d in byte_decisions(words, table_bits):
                logs[d.owner] += mixer.logs(d)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(logs / _LN10)], names=["token", "n", "spelt"])

    return tokens.mapInArrow(spell, "token binary, n long, spelt double")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_fold: int = 1) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    The model learns from rows whose crc32 of the id is not ``held_out_fold`` modulo 5; a null id
    counts as training. A null text counts as empty: one end mark. Without training rows no token is
    known and the mixer gives every decision nearly one half. Repeated rows are each learned from and
    scored; an empty table gives an empty result. Columns other than id and text are not looked at.
    """
    spark = docs.sparkSession
    prepare(spark)
    held = F.coalesce(F.crc32(docs[id_col].cast("string")) % 5 == held_out_fold, F.lit(False))
    own = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"), held.alias("held_out"))
    training = own.where(~F.col("held_out")).select("doc_id", "text")
    tokens = pinned(token_table(training))
    total = tokens.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    width = float(np.log10(n + 0.5 * (v + 1)))
    least = max(1, -(-n // SHARE))
    listed = {bytes(r["token"]): r["n"] for r in tokens.where(F.col("n") >= least).collect()}  # at most SHARE

    sc = spark.sparkContext
    table_bits = bits_for(n)
    tree = sc.broadcast(Tree(listed, n))

    def turns(batch, learning: bool):
        own = tree.value
        ids, endings, first, _ = own.ids_of(batch.column(0).to_pylist())
        contexts, single = own.contexts(ids, endings, first), own.single[ids]
        # learning, an occurrence is left out, and so a token that came once is not known
        yield from ((d, np.uint32(1)) for d in own.turns(contexts, np.where(single, own.escape, ids) if learning else ids, table_bits))
        if not learning and single.any():
            yield from ((d, np.uint32(1)) for d in own.turns([c[single] for c in contexts], np.full(int(single.sum()), own.escape), table_bits))

    turn_counts = sc.broadcast(_context_counts(training.select("text"), lambda b: turns(b, False), TURN_TABLES, table_bits))
    turn_weights = _weights(training.select("text"), ["text"], n, lambda b: turns(b, True), turn_counts, TURN_LEAD)

    # unlisted words are spelt as often as they come; a listed one, which is not spelt itself, shows once how words look
    words = tokens.where(F.col("token") != F.lit(END)).select("token", F.when(F.col("n") >= least, 1).otherwise(F.col("n")).cast("long").alias("n"))

    def letters(batch):
        times = np.minimum(batch.column(1).to_numpy(), 1 << 20).astype(np.uint32)
        found = [t + b" " for t in batch.column(0).to_pylist()]
        return ((d, np.repeat(times[d.owner], np.diff(np.concatenate([d.first, [len(d.bits)]])))) for d in byte_decisions(found, table_bits))

    byte_counts = sc.broadcast(_context_counts(words, letters, BYTE_TABLES, table_bits))
    byte_weights = _weights(words, ["token"], v, letters, byte_counts, BYTE_LEAD)

    def worker():
        return Scorer(tree.value, listed_counts.value, Mixer(turn_counts.value.whole(), TURN_LEAD, *turn_weights), table_bits)

    listed_counts = sc.broadcast(listed)
    # a row is named by its place: repeated and null ids stay apart
    tagged = own.select(F.struct("doc_id", "held_out", F.length(F.encode("text", "UTF-8")).alias("n_bytes")).alias("row"), "text")
    scored = map_texts(tagged, "row", "text", "n_tokens long, turns double, base double, rare array<struct<token:binary,n:long>>", worker)
    scored = pinned(scored.withColumnRenamed("doc_id", "row").withColumn("at", F.monotonically_increasing_id()))
    rare = scored.select("at", F.explode("rare").alias("r")).select("at", "r.token", F.col("r.n").alias("k"))
    different = rare.select("token").distinct().join(tokens, "token", "left")
    table = pinned(_spelt(different, byte_counts, *byte_weights, table_bits))
    c = F.coalesce("n", F.lit(0))
    looked = rare.join(table, "token").groupBy("at").agg(
        F.sum(F.col("k") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c == 0, F.col("k")).otherwise(0)).alias("unknown"), F.sum(F.col("k") * F.col("spelt")).alias("spelt")
    )
    both = scored.drop("rare").join(looked, "at", "left").na.fill(0, ["more", "unknown", "spelt"])
    score = F.col("turns") + F.col("spelt")
    return both.select(
        "row.doc_id",
        "row.held_out",
        "n_tokens",
        (F.col("n_tokens") - F.col("unknown")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") - F.col("n_tokens") * F.lit(width)).alias("base_score"),
        score.alias("score"),
        (-score / F.lit(float(np.log10(2.0))) / F.greatest("row.n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
