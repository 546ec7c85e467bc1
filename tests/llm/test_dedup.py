"""Deduplication operators against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

import siftwell.llm.graph as graph
import siftwell.llm.lines as lines
import siftwell.llm.simhash as simhash
import siftwell.llm.suffixes as suffixes
from siftwell.llm.exact_dedup import exact_dedup
from siftwell.llm.graph import components


def joined(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_exact(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(-1 if i is None else i)
    for r in exact_dedup(docs, support=0.05).collect():
        own = next(g for t, g in groups.items() if __import__("hashlib").sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(own) and (-1 if r.keep_id is None else r.keep_id) == max(own)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 3), (3, 9), (9, 5)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(2 * i, 2 * i + 1) for i in range(9)] + [(None, 3)]])
@pytest.mark.parametrize("local", [300_000, 4])
def test_components(spark, monkeypatch, edges, local):
    monkeypatch.setattr(graph, "LOCAL", local)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    roots = joined(60, real)
    assert got == {x: roots[x] for e in real for x in e}


def slow_fingerprint(text):
    words = [w for w in text.encode().translate(simhash.LOWER).split()]
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs):
    rows = docs.collect()
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = [slow_fingerprint(r.text or "") for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    roots = joined(len(rows), near)
    low = {c: min((rows[i].doc_id for i in range(len(rows)) if roots[i] == c and rows[i].doc_id is not None), default=None) for c in set(roots)}
    assert got == sorted(((r.doc_id, f"{p:016x}", low[c]) for r, p, c in zip(rows, prints, roots, strict=True)), key=str)


@pytest.mark.parametrize("hot,large,many", [(48, 4096, 1 << 23), (2, 4096, 1 << 23), (2, 5, 1 << 23), (2, 5, 1)])
def test_links_of_clusters(spark, monkeypatch, hot, large, many):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "MANY", many)
    rng = np.random.default_rng(3)
    values = {int(x) for x in rng.integers(0, 2**63, 40)}
    for centre in list(values)[:3]:
        values |= {centre ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 6), replace=False)) for _ in range(25)}
    fps = sorted(values)
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    roots = joined(len(fps), near)
    got = components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()
    assert {r.node: r.root for r in got} == {f: fps[c] for f, c in zip(fps, roots, strict=True) if roots.count(c) > 1}


def slow_passages(rows):
    seen = defaultdict(list)
    for i, text in rows:
        words = text.split()
        for a in range(len(words) - 49):
            seen[tuple(words[a : a + 50])].append((i, a))
    repeated, later = defaultdict(set), defaultdict(set)
    for places in seen.values():
        places = sorted(set(places))
        for i, a in places:
            if len(places) > 1:
                repeated[i].update(range(a, a + 50))
                if (i, a) != places[0] and not (i == places[0][0] and a - places[0][1] < 50):
                    later[i].update(range(a, a + 50))
    return repeated, later


@pytest.mark.parametrize("run", [8192, 3, 0])
def test_passages(docs, monkeypatch, run):
    monkeypatch.setattr(suffixes, "RUN", run)
    rows = {(r.doc_id, r.text) for r in docs.where("doc_id is not null and text is not null").collect()}
    repeated, later = slow_passages(rows)
    got, more = defaultdict(set), defaultdict(set)
    for r in suffixes.repeated_passages(docs.where("doc_id is not null")).collect():
        got[r.doc_id].update(range(r.first_word, r.end_word))
        more[r.doc_id].add((r.first_word, r.superfluous_words))
    assert got == repeated
    assert {i: sum(n for _, n in x) for i, x in more.items()} == {i: len(later[i]) for i in repeated}


@pytest.mark.parametrize("n", [0, 1, 22, 29, 49, 50, 51, 300])
def test_each_window_is_looked_into_once(n):
    words = np.random.default_rng(n).integers(0, 5, n, dtype=np.uint64)
    _, at, low, high = suffixes.suffix_rows(words)
    windows = sorted(p - a for p, least, most in zip(at.tolist(), low.tolist(), high.tolist(), strict=True) for a in range(least, most + 1))
    assert windows == list(range(max(0, n - 49)))


def test_cut_text(docs):
    rows = {(r.doc_id, r.text) for r in docs.where("doc_id is not null and text is not null").collect()}
    _, later = slow_passages(rows)
    kept = {r.doc_id: r.text for r in suffixes.without_repeats(docs.where("doc_id is not null and text is not null")).collect()}
    for i, text in rows:
        left = [w for n, w in enumerate(text.split()) if n not in later[i]]
        assert kept.get(i, "").split() == left


def test_lines(spark, monkeypatch):
    base = ["the quick brown fox jumps over the lazy dog again and again", "a wholly other line about something else entirely", "ab", "ab", "", "  "]
    near = [base[0].replace("lazy", f"laz{c}") for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(3, "\n".join(base)), (1, "\n".join([*near, "short"])), (2, base[1] + "!\n" + base[0]), (None, base[0]), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_lines(rows)
    for hot, tile in ((32, 4000), (2, 4000), (2, 5)):
        monkeypatch.setattr(lines, "HOT", hot)
        monkeypatch.setattr(lines, "TILE", tile)
        found = lines.fuzzy_lines(docs).collect()
        assert {(r.doc_id, r.line_no): r.kept for r in found} == {at: kept for at, (kept, _) in want.items()}
        # the same lines are together, whatever a component is called
        names, numbers = defaultdict(set), defaultdict(set)
        for r in found:
            if r.component is not None:
                names[r.component].add((r.doc_id, r.line_no))
        for at, (_, root) in want.items():
            if root is not None:
                numbers[root].add(at)
        assert {frozenset(x) for x in names.values()} == {frozenset(x) for x in numbers.values()}


def slow_lines(rows):
    places = sorted((1 << 62 if i is None else i, n, line) for i, t in rows for n, line in enumerate((t or "").split("\n")))
    different = sorted({line for _, _, line in places if line.strip()})
    sets = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in different]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots = dict(zip(different, joined(len(different), edges), strict=True))
    seen, out = set(), {}
    for i, n, line in places:
        kept = line not in roots or roots[line] not in seen
        seen.add(roots.get(line))
        out[None if i == 1 << 62 else i, n] = (kept, roots.get(line))
    return out


def test_band_recall():
    rng, hits = np.random.default_rng(4), 0
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    for _ in range(300):
        line = rng.choice(letters, 200)
        other = line.copy()
        for at in (30, 90, 110, 170):  # each takes five shingles away and brings five
            other[at] = "#"
        a, b = lines.bands(["".join(line), "".join(other)])
        hits += bool((a == b).any())
    assert hits >= 295


def test_bands_do_not_depend_on_neighbours():
    some = ["abc", "a longer line of text", "é", "abcde", "x" * 300]
    together = lines.bands(some)
    assert all((lines.bands([x])[0] == row).all() for x, row in zip(some, together, strict=True))


def test_line_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    some = ["", "a", "a line of text", "é ü 漢字 " * 30, "x" * 31, "x" * 32, "x" * 33]
    got = spark.createDataFrame([(x,) for x in some], "line string").select("line", F.xxhash64("line").alias("h")).collect()
    assert all(r.h % (1 << 64) == lines._hash(r.line) for r in got)


def test_shared_keys_pass_in_any_cut(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    entries = np.zeros(4000, lines._entry)
    entries["key"], entries["h"] = rng.integers(0, 1500, 4000), rng.integers(0, 40, 4000)
    entries["key"][:500] = 7
    want = {(int(k), int(h)) for k, h in entries.tolist()}
    several = {k for k in {k for k, _ in want} if sum(1 for x in want if x[0] == k) > 1}
    for held in (1, 100, 10_000):
        monkeypatch.setattr(lines, "HELD", held)
        batch = pa.RecordBatch.from_pydict({"bucket": [0] * 40, "entries": [entries[i : i + 100].tobytes() for i in range(0, 4000, 100)]})
        got = {(k, h) for out in lines._shared([batch]) for k, h in zip(out["key"].to_pylist(), out["h"].to_pylist(), strict=True)}
        assert got == {(k, h) for k, h in want if k in several}


def test_similarities_are_exact():
    rng = np.random.default_rng(8)
    some = ["", "ab", "abcdefghij" * 9, "é漢" * 40] + ["".join(rng.choice(list("abc "), n)) for n in (4, 5, 6, 30, 300, 3000)]
    pairs = [(x or "x", y or "x") for x in some for y in some] + [(x, x[:-2] + "zz") for x in some[2:]]
    want = [len(lines.shingles(x) & lines.shingles(y)) / len(lines.shingles(x) | lines.shingles(y)) for x, y in pairs]
    assert lines.similarities([x for x, _ in pairs], [y for _, y in pairs]) == pytest.approx(want)
