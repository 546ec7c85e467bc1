"""Token counts by a compiled finite-state tokenizer.

The byte-pair encoder is a deterministic transducer (:class:`siftwell.llm.bpe.PrefixAutomaton`):
each transition carries the number of tokens it adds. A text is cut into spans; a span's state map
is its open head, the count of the blocks inside, and its open tail. Maps compose associatively, so
the spans of a text are folded by a prefix scan in a balanced tree, and the count does not depend on
where the cuts fall.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame

from siftwell.llm.bpe import PrefixAutomaton, byte_level
from siftwell.llm.common import map_texts
from siftwell.llm.pretokens import blocks, segments, spaced, words_of
from siftwell.llm.wordcache import WordCache

#: Characters of a span.
SPAN = 1 << 16


class StateMap(NamedTuple):
    """What a span does to the count: ``inner`` is None while the span holds no block border."""

    head: str
    inner: int | None
    tail: str


class TokenCounter:
    def __init__(self, path: str):
        self.path = path
        merges, self.special = byte_level(path)
        self.automaton = PrefixAutomaton(merges)
        self._library = None
        self.led = WordCache(lambda part: self.block(" " + part))
        self.bare = WordCache(self.block)

    def library(self):
        """The tokenizer itself, asked only for classes of characters that Unicode versions disagree on."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def block(self, block: str) -> int:
        return sum(self.automaton.count(w.encode()) for w in words_of(block, self.library))

    def whole(self, text: str) -> int:
        """Tokens of a text that starts where a block starts."""
        parts = spaced(text)
        if parts is None:
            return sum(self.bare.all(blocks(text)))
        return sum(self.bare.all(parts[:1])) + sum(self.led.all(parts[1:]))

    def state_map(self, span: str) -> StateMap:
        cut = blocks(span)
        if len(cut) < 2:
            return StateMap(span, None, "")
        inner = span[len(cut[0]) : len(span) - len(cut[-1])]
        return StateMap(cut[0], self.whole(inner) if inner else 0, cut[-1])

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of two adjoining spans."""
        if a.inner is None and b.inner is None:
            return self.state_map(a.head + b.head)
        if a.inner is None:
            left = self.state_map(a.head + b.head)
            closed = 0 if left.inner is None else left.inner + self.block(left.tail)
            return StateMap(left.head, closed + b.inner, b.tail)
        if b.inner is None:
            right = self.state_map(a.tail + b.head)
            if right.inner is None:
                return StateMap(a.head, a.inner, right.head)
            return StateMap(a.head, a.inner + self.block(right.head) + right.inner, right.tail)
        return StateMap(a.head, a.inner + self.whole(a.tail + b.head) + b.inner, b.tail)

    def segment(self, text: str) -> int:
        if not text:
            return 0
        if len(text) <= SPAN:
            return self.whole(text)
        maps = [self.state_map(text[i : i + SPAN]) for i in range(0, len(text), SPAN)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        only = maps[0]
        return self.block(only.head) + (only.inner or 0) + (self.block(only.tail) if only.tail else 0)

    def count(self, text: str) -> int:
        texts, specials = segments(text, self.special)
        return sum(map(self.segment, texts)) + len(specials)


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are those of the byte-level tokenizer file at ``path`` without begin or end tokens; its
    special strings inside a text count as one token each. A null text counts as empty and has no
    token; null ids and repeated rows pass through; an empty table gives an empty result. Columns
    other than id and text are not looked at.
    """

    def worker():
        count = counter(path).count

        def work(texts: list[str]):
            n = [count(t) for t in texts]
            return None, [[len(t.encode()) for t in texts], n, [x > limit for x in n]]

        return work

    return map_texts(docs, id_col, text_col, "n_bytes long, n_tokens long, over_limit boolean", worker)
