"""A bucket of many lines that are not alike is linked without comparing their shingle sets pair by pair."""

import random
import time

import siftwell.llm.lines as L


def test_links_of_a_large_bucket_are_found_soon():
    rng = random.Random(6)
    lines = ["".join(rng.choice("aeiounrst ") for _ in range(300)) for _ in range(2400)]
    near = [line[:k] + "#" + line[k + 1 :] for line, k in zip(lines[:40], range(0, 240, 6), strict=True)]
    began = time.process_time()
    found = L.link_lines(list(range(2440)), lines + near, [*range(2439), 39])
    taken = time.process_time() - began
    # the last line has the root of its like, and so needs no link to it
    assert {tuple(sorted(e)) for e in found} == {(k, 2400 + k) for k in range(39)}
    assert taken < 6


def test_links_join_what_pairs_would_join():
    rng = random.Random(7)
    lines = ["a", "ab", "abc", "x" * 700]
    for size in (4, 30, 90, 400):
        line = [rng.choice("abcdefg é") for _ in range(size)]
        for _ in range(12):
            lines.append("".join(rng.choice("abcdefg é") if rng.random() < 0.03 else x for x in line))
    lines = list(dict.fromkeys(lines))
    sets, parent = [L.shingles(x) for x in lines], {}

    def top(x, of):
        while of.get(x, x) != x:
            x = of[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if L.similar(sets[i], sets[j]):
                parent[max(top(i, parent), top(j, parent))] = min(top(i, parent), top(j, parent))
    own = {}
    for a, b in L.link_lines(list(range(len(lines))), lines, list(range(len(lines)))):
        own[max(top(a, own), top(b, own))] = min(top(a, own), top(b, own))
    assert [top(i, own) for i in range(len(lines))] == [top(i, parent) for i in range(len(lines))] and 4 < len({top(i, own) for i in range(len(lines))}) < len(lines)
