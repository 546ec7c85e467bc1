"""Repeated passages through a sparse suffix array.

Only suffixes at content-selected positions are kept: every window of ``LEAST`` words selects the
position whose following ``GRAM`` words hash lowest (a minimiser), the first of equal ones. Equal
windows select equal positions, so each window is looked into at one suffix only, as so many words
before its position and the rest from it on. Windows with at most ``HALF`` words in front all hold
the words right behind the position, the others all hold those right before it; suffixes whose words
there occur once are dropped. What is left falls into runs that share those words. The suffixes of a
run are sorted by the words that follow and by those that precede, and what neighbours have in
common extends each to the right and to the left: two windows are equal where both extensions reach.

In a run of more than ``RUN`` suffixes, those that agree in all words of all their windows are repeats of
the first of them, which alone goes on. A run that is still too long is split by the words that fewer
windows share, at last down to single windows. So no task holds more than some ``RUN`` suffixes of
bounded size, however often a passage occurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import map_texts, pinned, prepare, text_of

#: Words a passage must have, and words that are hashed to select positions.
LEAST, GRAM = 50, 8
#: Most words of a window in front of its selected position, and most of those that are found by the words behind it.
LEFT, HALF = LEAST - GRAM, (LEAST - GRAM) // 2
#: Suffixes of a run, and of several runs together, that one task matches in memory.
RUN = 8192
#: Windows of a suffix that stay together when a longer run is split, step by step.
PARTS = (HALF + 1, 6, 1)
#: Bytes of a word that are carried along; a longer one is known by its SHA-256.
LONG_WORD = 64
_FACTOR = 0x9E3779B97F4A7C15
#: A position in a text takes so many bits of a packed gram.
_PLACE = np.uint64(31)
_word = re.compile(r"[^\x20\x09-\x0D]+")


def word_hashes(text: str) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    words = text.encode().split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every ``width`` consecutive values, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def _rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` consecutive words."""
    n = max(0, len(words) - width + 1)
    sums = np.zeros(n, np.uint64)
    for j in range(width):
        sums = sums * np.uint64(_FACTOR) + words[j : j + n]
    return _mixed(sums)


def selected(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected positions of a text of word hashes, and the least and most words before them in their windows."""
    if len(words) < LEAST:
        return (np.empty(0, np.int64),) * 3
    grams = _rolling(words, GRAM)
    packed = (grams >> _PLACE << _PLACE) | np.arange(len(grams), dtype=np.uint64)
    lowest = _sliding(packed, LEFT + 1, np.minimum)
    chosen = (lowest & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)  # by first word of the window
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [len(chosen)]]) - 1
    at = chosen[first]
    return at, at - last, at - first


def suffix_rows(words: np.ndarray) -> list[np.ndarray]:
    """``key, at, low, high``: each suffix under the hash of the words that its windows on either side share."""
    at, low, high = selected(words)
    near, far = low <= HALF, high > HALF
    near_keys = _rolling(words, LEAST - HALF)[at[near]]
    far_keys = _mixed(_rolling(words, HALF + 1 + GRAM)[at[far] - HALF - 1] + np.uint64(1))
    return [
        np.concatenate([near_keys, far_keys]).view(np.int64),
        np.concatenate([at[near], at[far]]),
        np.concatenate([low[near], np.maximum(low[far], HALF + 1)]),
        np.concatenate([np.minimum(high[near], HALF), high[far]]),
    ]


def _in_common(codes: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by run and words, words each shares with its predecessor there, and the most it shares with a neighbour."""
    flat = np.concatenate([run.astype(">u4")[:, None], codes.astype(">u4")], axis=1)
    order = np.argsort(np.ascontiguousarray(flat).view(f"S{4 * flat.shape[1]}")[:, 0], kind="stable")
    sorted_codes, sorted_runs = codes[order], run[order]
    same = (sorted_codes[1:] == sorted_codes[:-1]) & (sorted_runs[1:] == sorted_runs[:-1])[:, None]
    shared = np.concatenate([[0], np.logical_and.accumulate(same, axis=1).sum(axis=1)])
    shared[np.flatnonzero(np.concatenate([[True], sorted_runs[1:] != sorted_runs[:-1]]))] = -1
    most = np.empty(len(order), np.int64)
    most[order] = np.maximum(shared, np.concatenate([shared[1:], [-1]]))
    return order, shared, most


def match_runs(key: np.ndarray, order: np.ndarray, k: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, words: pa.Array) -> dict[str, np.ndarray]:
    """Repeated stretches of whole runs of equal ``key``: ``k, first, end, kept``.

    ``k`` names the text. ``words`` holds the words of each suffix from ``high`` before its position to the end of its last
    window. ``kept`` is true for all that repeats and false again for what an earlier copy makes
    superfluous; null stands for both.
    """
    by = np.lexsort((at, k, order, key))  # of equal windows the earliest comes first
    by = by[np.concatenate([[True], (key[by[1:]] != key[by[:-1]]) | (k[by[1:]] != k[by[:-1]]) | (at[by[1:]] != at[by[:-1]])])]
    key, k, at, low, high, words = key[by], k[by], at[by], low[by], high[by], words.take(pa.array(by))
    n, run = len(key), np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    lists = pc.split_pattern(words, " ")
    sizes = (high - low + LEAST).astype(np.int64)
    row = np.repeat(np.arange(n), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(LEFT - high, sizes)
    around = np.zeros((n, LEFT + LEAST), np.uint32)
    around[row, place] = pc.dictionary_encode(lists.flatten()).indices.to_numpy().astype(np.uint32) + 1
    right, before_right, most_right = _in_common(around[:, LEFT:], run)
    left, before_left, most_left = _in_common(around[:, LEFT - 1 :: -1], run)
    repeated, later = np.zeros((n, LEFT + 1), bool), np.zeros((n, LEFT + 1), bool)
    group = np.empty((2, n), np.int64)
    for a in range(LEFT + 1):
        own = np.flatnonzero((low <= a) & (a <= high) & (most_right >= LEAST - a) & (most_left >= a))
        if len(own) < 2:
            continue
        # suffixes that agree in the words behind them lie side by side in one order, those that agree before them in the other
        group[0, right], group[1, left] = np.cumsum(before_right < LEAST - a), np.cumsum(before_left < a)
        both = group[0, own] * (n + 1) + group[1, own]
        by = np.argsort(both, kind="stable")
        own, both = own[by], both[by]
        new = np.concatenate([[True], both[1:] != both[:-1]])
        head = own[np.flatnonzero(new)[np.cumsum(new) - 1]]
        alone = new & np.concatenate([new[1:], [True]])
        repeated[own[~alone], a] = True
        # a window that overlaps the first copy in its own text is no second copy
        later[own[~new & ~((k[own] == k[head]) & (at[own] - at[head] < LEAST))], a] = True
    out = {"k": [], "first": [], "end": [], "kept": []}
    for kept, flags in ((True, repeated), (False, later)):
        edge = np.zeros((n, 1), bool)
        grown = np.concatenate([edge, flags, edge], axis=1)
        r, least = np.nonzero(grown[:, 1:] & ~grown[:, :-1])
        _, end = np.nonzero(~grown[:, 1:] & grown[:, :-1])
        out["k"].append(k[r])
        out["first"].append(at[r] - end + 1)
        out["end"].append(at[r] - least + LEAST)
        out["kept"].append(np.full(len(r), kept))
    return {c: np.concatenate(v) for c, v in out.items()}


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, ord, k, text`` of every row: its place in the order of documents, and the digest of its text."""
    text = text_of(docs, text_col)
    order = F.coalesce(docs[id_col].try_cast("long"), F.lit((1 << 63) - 1))
    return docs.select(docs[id_col].alias("doc_id"), order.alias("ord"), F.unhex(F.md5(text)).alias("k"), text.alias("text"))


def _packed(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (at.astype(np.int64) << 16) | (low << 8) | high


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, (place >> 8) & 255, place & 255


def _suffixes(own: DataFrame) -> DataFrame:
    """``k, key, place`` of every kept suffix of ``own (k, text)``; a null key comes with the words of the text."""

    def worker():
        def work(texts: list[str]):
            rows, keys, places = [], [], []
            for i, text in enumerate(texts):
                words = word_hashes(text)
                if len(words) >= LEAST:
                    key, *place = suffix_rows(words)
                    rows.append(np.full(len(key) + 1, i))
                    keys.append(np.concatenate([key, [0]]))
                    places.append(np.concatenate([_packed(*place), [-len(words)]]))
            if not rows:
                return np.empty(0, np.int64), [np.empty(0, np.int64)] * 2
            place = np.concatenate(places)
            return np.concatenate(rows), [pa.array(np.concatenate(keys), mask=place < 0), place]

        return work

    return map_texts(own, "k", "text", "key long, place long", worker).withColumnRenamed("doc_id", "k")


def _each_text(batches: Iterator[pa.RecordBatch]):
    """``k, ord, words, keys, places`` of rows ``k, ord, text, found``."""
    from hashlib import sha256

    for batch in batches:
        found = batch.column(3)
        ends, parts = found.offsets.to_numpy() - found.offsets[0].as_py(), found.flatten()
        key, place = (pc.struct_field(parts, c).to_numpy() for c in ("key", "place"))
        for i, (k, order, text) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True)):
            words = [w if len(w) <= LONG_WORD else b"\0" + sha256(w).hexdigest().encode() for w in text.encode().split()]
            yield k, order, words, key[ends[i] : ends[i + 1]], place[ends[i] : ends[i + 1]]


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) if isinstance(c, list) else pa.array(c) for c in columns], names=names)


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each suffix, with the words that its windows hold."""
    for k, order, words, key, place in _each_text(batches):
        at, low, high = _unpacked(place)
        held = [b" ".join(words[p - b : p - a + LEAST]) for p, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True)]
        yield _rows(["key", "ord", "k", "place", "words"], key, np.full(len(key), order), [k] * len(key), place, held)


def _split(width: int):
    """Rows ``ord, k, place, words`` to a row for every ``width`` windows of theirs, under the hash of the words that those share, with a digest of all their words.

    Those of a text that agree in these words are one row of several places, as far as they come together.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        for batch in batches:
            at, low, high = _unpacked(batch.column(2).to_numpy())
            found: dict[tuple, list] = {}
            for p, a, b, order, k, own in zip(at.tolist(), low.tolist(), high.tolist(), *[batch.column(c).to_pylist() for c in (0, 1, 3)], strict=True):
                words = own.split(b" ")
                for least in range(a - a % width, b + 1, width):
                    first, last = max(a, least), min(b, least + width - 1)
                    held = b" ".join(words[b - last : b - first + LEAST])
                    row = found.get((k, order, first, last, held))
                    if row is None:
                        key = xxh3_64_intdigest(b" ".join(words[b - least : b - least - width + 1 + LEAST]), least)
                        row = found[k, order, first, last, held] = [key, xxh3_128_digest(held, (first << 8) | last), []]
                    row[2].append((p << 16) | (first << 8) | last)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array([key for key, _, _ in found.values()], np.uint64).view(np.int64)),
                    pa.array([order for _, order, _, _, _ in found], pa.int64()), pa.array([k for k, *_ in found], pa.binary()),
                    pa.array([sorted(places) for _, _, places in found.values()], pa.list_(pa.int64())), pa.array([held for *_, held in found], pa.binary()),
                    pa.array([extent for _, extent, _ in found.values()], pa.binary()),
                ],
                names=["key", "ord", "k", "places", "words", "extent"],
            )

    return split


def _match_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_around`, sorted by key, through :func:`match_runs`: whole runs, some RUN suffixes at a time."""

    def done(held: pa.Table) -> pa.RecordBatch:
        names = pc.dictionary_encode(held["k"].combine_chunks())
        order, texts = held["ord"].to_numpy(), np.array(names.dictionary.to_pylist(), "S16")
        # texts of equal place in the order of documents are ordered by digest, the same in every run
        rank = np.empty(len(texts), np.int64)
        rank[np.argsort(texts)] = np.arange(len(texts))
        k = rank[names.indices.to_numpy()]
        found = match_runs(held["key"].to_numpy(), order, k, *_unpacked(held["place"].to_numpy()), held["words"].combine_chunks())
        back = names.dictionary.take(pa.array(np.argsort(texts)))
        return pa.RecordBatch.from_pydict({c: back.take(pa.array(v)) if c == "k" else pa.array(v) for c, v in found.items()})

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= RUN:
            table = pa.Table.from_batches(held)
            key = table["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield done(table.slice(0, cut))
                held, rows = table.slice(cut).to_batches(), rows - cut
    if rows:
        yield done(pa.Table.from_batches(held))


def _extents(rows: DataFrame) -> DataFrame:
    """Of each ``extent`` of ``rows`` the first place and how many there are."""
    first = F.struct("ord", "k", F.col("places")[0].alias("place"))
    return rows.groupBy("extent").agg(F.min(first).alias("best"), F.sum(F.size("places")).alias("n"), F.count(F.lit(1)).alias("rows"))


def _with_first(rows: DataFrame, extents: DataFrame) -> DataFrame:
    """``rows (ord, k, places, extent)`` with ``n``, how many places have the extent, and ``ones``: the first of them and those that overlap it in its own text.

    Extents with more than a thousandth of the rows, at most a thousand of them, are joined by broadcast.
    """
    often = max(1, rows.count() // 1000)
    marked = rows.join(F.broadcast(extents.where(F.col("rows") > often).drop("rows")), "extent", "left")
    rest = marked.where("best is null").drop("best", "n").join(extents.where(F.col("rows") <= often).drop("rows"), "extent")
    near = F.filter("places", lambda p: F.shiftright(p, 16) - F.shiftright("best.place", 16) < LEAST)
    ones = F.when(F.col("k") == F.col("best.k"), near).otherwise(F.array().cast("array<bigint>"))
    return marked.where("best is not null").unionByName(rest).withColumn("ones", ones).drop("best")


def _copies(marked: DataFrame) -> DataFrame:
    """``k, spans`` of the rows of :func:`_with_first` whose extent has several places."""

    def span(p):
        at, low, high = F.shiftright(p, 16), F.shiftright(p, 8).bitwiseAND(F.lit(255)), p.bitwiseAND(F.lit(255))
        return F.struct((at - high).alias("first"), (at - low + LEAST).alias("end"), F.when(F.array_contains("ones", p), F.lit(True)).alias("kept"))

    return marked.where("n > 1").select("k", F.transform("places", span).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted((s["first"], s["end"]) for s in spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        ks, repeated, later = [], [], []
        for k, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ks.append(k)
            for other, out in ((False, repeated), (True, later)):
                out.append([{"first": a, "end": b} for a, b in merged([s for s in spans if s["kept"] is not other])])
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()), pa.array(repeated, kind), pa.array(later, kind)], names=["k", "repeated", "later"])


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``k, ord, repeated, later``: merged word spans of each row that has any.

    Equal texts are looked into once, as the first of them; the others repeat it as a whole.
    """
    prepare(docs.sparkSession)
    own = _documents(docs, id_col, text_col)
    suffixes = pinned(_suffixes(own.where(F.length("text") >= 2 * LEAST - 1).select("k", "text")))
    copies = pinned(own.groupBy("k").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")))

    def runs_of(rows: DataFrame) -> DataFrame:
        """``rows`` whose key occurs in several places, with ``n``, the number of rows that share it."""
        one = F.struct("k", F.shiftright("place", 16))
        often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("low"), F.max(one).alias("high"))
        return rows.join(often.where("low != high").select("key", "n"), "key")

    def in_texts(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("k").agg(F.collect_set(F.struct("key", "place")).alias("found")).join(copies.select("k", F.col("first_ord").alias("ord")), "k")
        return own.select("k", "ord", "text").join(lists, ["k", "ord"]).select("k", "ord", "text", "found")

    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = pinned(runs_of(suffixes.where("key is not null")))
    run = "key long, ord long, k binary, place long, words binary"
    few = in_texts(found.where(F.col("n") <= RUN)).mapInArrow(_around, run)
    long = in_texts(found.where(F.col("n") > RUN)).mapInArrow(_around, run) if not found.where(F.col("n") > RUN).isEmpty() else None
    copies_in_long = None
    for windows in PARTS:
        if long is None:
            break
        # of equal extents one goes on, with those that overlap it; they are compared with what shares a part of it
        parts = pinned(long.select("ord", "k", "place", "words").mapInArrow(_split(windows), "key long, ord long, k binary, places array<long>, words binary, extent binary"))
        marked = pinned(_with_first(parts, pinned(_extents(parts))))
        copies_in_long = _copies(marked) if copies_in_long is None else copies_in_long.unionByName(_copies(marked))
        ones = marked.where(F.size("ones") > 0).select("key", "ord", "k", F.explode("ones").alias("place"), "words")
        ones = pinned(ones.join(ones.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"))
        if windows > 1:
            few = few.unionByName(ones.where(F.col("n") <= RUN).drop("n"))
        long = None if ones.where(F.col("n") > RUN).isEmpty() else ones.where(F.col("n") > RUN)
    spans = few.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_match_sorted, "k binary, first long, end long, kept boolean")
    spans = spans.select("k", F.array(F.struct("first", "end", "kept")).alias("spans"))
    spans = spans if copies_in_long is None else spans.unionByName(copies_in_long)
    lists = spans.groupBy("k").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    span = "array<struct<first:bigint,end:bigint>>"
    merged_spans = lists.mapInArrow(_merge, f"k binary, repeated {span}, later {span}")

    n_words = suffixes.where("key is null").select("k", (-F.col("place")).alias("n_words")).distinct()
    copied = F.col("n_words").isNotNull() & (F.col("first_ord") != F.col("last_ord"))
    both = copies.join(n_words, "k", "left").join(merged_spans, "k", "left").withColumn("copied", copied).where("copied or repeated is not null")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("end")))
    none = F.array().cast(span)
    return own.select("k", "ord").distinct().join(both, "k").select(
        "k",
        "ord",
        F.when(F.col("copied"), whole).otherwise(F.col("repeated")).alias("repeated"),
        F.when(F.col("copied") & (F.col("ord") != F.col("first_ord")), whole).otherwise(F.coalesce("later", none)).alias("later"),
    )


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated span: ``doc_id, first_word, end_word, n_words, superfluous_words``.

    A span is a stretch of words, each in a passage of at least 50 words that occurs elsewhere;
    ``superfluous_words`` says how many of them an earlier copy already holds (0 where the copy is the
    first). Copies are ordered by id, null last, then by place. Words are separated by ASCII white
    space and compared exactly; words over 64 bytes, whole texts and the windows of runs of more than
    ``RUN`` suffixes are told apart by digests of 128 bits or more. Null, empty and shorter texts have no span. Rows that repeat an id
    with the same text are one document, and each gets its spans. An empty table gives an empty
    result; other columns are not looked at.
    """
    spans = pinned(_spans(docs, id_col, text_col))
    named = _documents(docs, id_col, text_col).select("doc_id", "ord", "k").join(spans, ["k", "ord"])
    each = named.select("doc_id", F.explode("repeated").alias("r"), "later")
    shared = F.aggregate(
        "later",
        F.lit(0).cast("long"),
        lambda n, s: n + F.greatest(F.lit(0).cast("long"), F.least(s["end"], F.col("r.end")) - F.greatest(s["first"], F.col("r.first"))),
    )
    return each.select(
        "doc_id", F.col("r.first").alias("first_word"), F.col("r.end").alias("end_word"), (F.col("r.end") - F.col("r.first")).alias("n_words"), shared.alias("superfluous_words")
    )


def cut_spans(text: str, spans: list[dict]) -> str:
    """``text`` without the words in ``spans`` and the white space behind them."""
    places = [m.start() for m in _word.finditer(text)] + [len(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : places[s["first"]]])
        at = places[s["end"]]
    return "".join([*out, text[at:]])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every repeated passage left only in its first copy; documents that have nothing else left go.

    Other columns stay; a text without a superfluous span stays as it is, empty and null ones too.
    """
    spans = pinned(_spans(docs, id_col, text_col)).where(F.size("later") > 0).select(F.col("k").alias("_k"), F.col("ord").alias("_o"), F.col("later").alias("_later"))

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, lambda t, s: cut_spans(t, s))

    text = text_of(docs, text_col)
    tagged = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_doc"),
        F.unhex(F.md5(text)).alias("_key"),
        F.coalesce(docs[id_col].try_cast("long"), F.lit((1 << 63) - 1)).alias("_ord"),
    )
    joined = tagged.join(spans, (F.col("_key") == F.col("_k")) & (F.col("_ord") == F.col("_o")), "left")
    whole = joined.where("_later is null").select("_doc.*")
    shorter = joined.where("_later is not null").withColumn("_text", cut(F.col(f"_doc.{text_col}"), F.col("_later"))).where("length(_text) > 0")
    shorter = shorter.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_doc.`{c}`") for c in docs.columns])
    return whole.unionByName(shorter)
