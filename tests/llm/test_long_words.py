"""Words whose probability is below any float are scored in full, and in parts as in one."""

import numpy as np
import pytest

import siftwell.llm.lm_scoring as lm
from test_scores import random_mixer, spell


def test_long_words_cost_their_length(monkeypatch):
    mixer = random_mixer(lm.BYTE_TABLES, lm.BYTE_LEAD)
    words = [bytes(np.random.default_rng(n).integers(97, 123, n).astype(np.uint8)) + b" " for n in (100, 1_000, 10_000, 100_000)]
    costs = spell(mixer, words)
    assert all(cost < -0.05 * len(word) for word, cost in zip(words, costs, strict=True))
    assert costs[3] == pytest.approx(10 * costs[2], rel=0.1)
    monkeypatch.setattr(lm, "SWEEP", 1 << 20)
    assert spell(mixer, words) == pytest.approx(costs, rel=1e-9)
