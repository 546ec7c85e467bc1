"""Large pieces of different lengths share sequences two by two."""

import random

import pytest
from siftwell.llm.packing import plan

RNG = random.Random(6)


@pytest.mark.parametrize("lengths", [list(range(683, 1025)), [RNG.randint(683, 1024) for _ in range(1000)], [RNG.randint(683, 1024) for _ in range(10_000)]])
def test_large_pieces_are_paired(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    runs = plan(histogram)
    used = {r.sequence + k for r in runs for k in range(-(-r.n // r.each))}
    assert len(used) == len(lengths) // 2 and sum(r.n for r in runs) == len(lengths)
