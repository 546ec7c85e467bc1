"""A bounded memo for per-word results inside a worker process."""

from __future__ import annotations


class WordCache:
    """Two generations of a plain dict: words in use move to the young one, the rest age out.

    Corpus words follow a steep frequency curve, so a bounded memo answers nearly all look-ups
    while memory stays flat however large the vocabulary grows.
    """

    def __init__(self, make, limit: int = 300_000, make_all=None):
        self.make_all = make_all or (lambda words: list(map(make, words)))
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def all(self, words: list) -> list:
        """The results for ``words``, in order; those not known are made together."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young = self.young
        found = list(map(young.get, words))
        if None in found:
            at = [i for i, value in enumerate(found) if value is None]
            fresh = dict.fromkeys(words[i] for i in at)
            new = []
            for word in fresh:
                value = self.old.get(word)
                if value is None:
                    new.append(word)
                else:
                    fresh[word] = value
            fresh.update(zip(new, self.make_all(new), strict=True))
            for i in at:
                found[i] = fresh[words[i]]
            young.update((word, value) for word, value in fresh.items() if len(word) <= 64)
        return found
