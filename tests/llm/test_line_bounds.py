"""Candidates of the line operator that cannot be similar are passed over before their lines travel."""

import random

import numpy as np
import siftwell.llm.lines as L


def some_lines():
    rng = random.Random(4)
    lines = []
    for size in [3, 5, 40, 300, 900] * 6:
        line = [rng.choice("aeioulnrst ") for _ in range(size)]
        for edits in (0, size // 60, size // 25, size // 10, size // 3):
            changed = list(line)
            for at in rng.sample(range(size), edits):
                changed[at] = rng.choice("aeioulnrst ")
            lines.append("".join(changed))
    wide = [chr(rng.randrange(0x4E00, 0x9E00)) for _ in range(40000)]
    return [*lines, "x" * 5000, "".join(wide), "".join(wide[9:])]


def test_no_similar_pair_is_passed_over():
    lines = some_lines()
    i, j = np.triu_indices(len(lines), 1)
    sets = [L.shingles(line) for line in lines]
    similar = np.array([L.similar(sets[a], sets[b]) for a, b in zip(i, j, strict=True)])
    bins = L.binned(lines)
    may = L.may_be_similar(bins[i], bins[j])
    assert similar.sum() > 30 and (may | ~similar).all() and may.mean() < 0.3
    assert (L.binned(lines[:4]) == bins[:4]).all() and (bins.max() == L.MOST)


def test_lines_far_apart_do_not_travel(spark, monkeypatch):
    """Lines in one bucket that cannot be similar are not joined with their texts."""
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(12)]
    lines += [line + "!" for line in lines[:5]]
    nodes = [bytes([k]) * 16 for k in range(len(lines))]
    rows = [(k, n, line) for k, (n, line) in enumerate(zip(nodes, lines, strict=True))]
    known = spark.createDataFrame(rows, "h long, node binary, line string").mapInArrow(L._with_bins, "h long, node binary, line string, bins binary")
    members = spark.createDataFrame([(7, n, n) for n in nodes], "key long, node binary, root binary")
    seen, pinned = [], L.pinned
    monkeypatch.setattr(L, "pinned", lambda df: seen.append((df.columns, out := pinned(df))) or out)
    found = {(bytes(r.a), bytes(r.b)) for r in L._linked(members, known, 3).collect()}
    assert found == {(nodes[k], nodes[12 + k]) for k in range(5)}
    assert [df.count() for columns, df in seen if columns == ["a", "b"]] == [5, 5]
