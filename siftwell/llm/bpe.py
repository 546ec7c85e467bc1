"""Byte-pair encoding as a deterministic automaton over prefixes.

For a vocabulary in which every token is the encoding of its own text, the encoding of a prefix
ends in one particular token, and that token follows from the last tokens of shorter prefixes: it
is the one vocabulary match ending there that is compatible with the last token before it. Two
tokens are compatible when encoding their joined text gives back just those two. An automaton
state therefore needs only the trie nodes that are still alive, each with the last token and the
token count at the place where it was entered. States are compiled on first use and kept.
"""

from __future__ import annotations

import json
from math import inf

#: Compiled states that a worker keeps.
MAX_STATES = 120_000
NONE = -1


class MergeTable:
    """Vocabulary, merge ranks and merge trees of one byte-pair encoding.

    ``spell`` maps a token to its symbols (``bytes`` or ``str``), ``split`` a merged token to its
    two parts, ``rank`` a merged token to its priority (lower merges first), and ``join(u, v)``
    gives the token that merging ``u`` and ``v`` makes, or None.
    """

    def __init__(self, spell: dict, split: dict, rank: dict, join):
        self.spell, self.split, self.rank, self.join = spell, split, rank, join
        self._right: dict = {}
        self._left: dict = {}
        self._pairs: dict = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens on one edge of the merge tree, each with the rank at which it is merged away."""
        memo = self._right if side else self._left
        if token not in memo:
            out, limit, at = [], inf, token
            while True:
                out.append((at, limit))
                if at not in self.split:
                    break
                limit, at = self.rank[at], self.split[at][side]
            memo[token] = out
        return memo[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border when the texts of ``a`` and ``b`` are encoded together."""
        if a < 0:  # the start of the word, or a symbol outside the vocabulary
            return True
        key = (a, b)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            known = self._pairs[key] = self._free(a, b)
        return known

    def _free(self, a: int, b: int) -> bool:
        for u, last_u in self._spine(a, 1):
            for v, last_v in self._spine(b, 0):
                made = self.join(u, v)
                # of equal merges the leftmost goes first: the crossing one yields to its left, not to its right
                if made is not None and self.rank[made] < last_u and self.rank[made] <= last_v:
                    return False
        return True


class PrefixAutomaton:
    """Per symbol: the next state, the change in token count, and the last token of the prefix.

    Transitions are compiled on first use. Once the table is full, the rest of a word that leaves it
    is stepped through without being kept.
    """

    def __init__(self, merges: MergeTable, unknown=None):
        self.merges, self.unknown = merges, unknown
        kids: list[dict] = [{}]
        ends: dict[int, int] = {}
        for token, text in merges.spell.items():
            node = 0
            for symbol in text:
                nxt = kids[node].get(symbol)
                if nxt is None:
                    nxt = kids[node][symbol] = len(kids)
                    kids.append({})
                node = nxt
            ends[node] = token
        none: dict = {}
        self.kids = [k or none for k in kids]
        self.token_at = [ends.get(node, NONE) for node in range(len(kids))]
        self.start = ((0, NONE, 0),)
        self.states = [self.start]
        self.ids = {self.start: 0}
        self.steps: list[dict] = [{}]

    def _after(self, key: tuple, symbol) -> tuple[tuple, int, int]:
        """Key of the state behind ``key`` on ``symbol``, the change in count, the last token."""
        kids, token_at, merges = self.kids, self.token_at, self.merges
        alive, last, count = [], NONE, 1
        for node, before, offset in key:
            child = kids[node].get(symbol)
            if child is None:
                continue
            if kids[child]:
                alive.append((child, before, offset))
            if last == NONE:
                token = token_at[child]
                if token >= 0 and (before < 0 or merges.compatible(before, token)):
                    last, count = token, 1 - offset
        if last == NONE:
            if self.unknown is None:
                raise ValueError(f"no token ends at {symbol!r}")
            return ((0, self.unknown(symbol), 0),), 1, self.unknown(symbol)
        return ((0, last, 0), *[(n, b, o + count) for n, b, o in alive]), count, last

    def _compile(self, state: int, symbol):
        """The transition (next state, emitted count, last token), kept while there is room."""
        key, count, last = self._after(self.states[state], symbol)
        nxt = self.ids.get(key)
        if nxt is None:
            if len(self.states) >= MAX_STATES:
                return None
            nxt = self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        step = self.steps[state][symbol] = (nxt, count, last)
        return step

    def run(self, word) -> tuple[int, list[int]]:
        """Token count of ``word``, and the last token of each of its prefixes."""
        steps, state, total, last = self.steps, 0, 0, []
        for at, symbol in enumerate(word):
            step = steps[state].get(symbol) or self._compile(state, symbol)
            if step is None:
                key = self.states[state]
                for rest in word[at:]:
                    key, count, token = self._after(key, rest)
                    total += count
                    last.append(token)
                break
            state = step[0]
            total += step[1]
            last.append(step[2])
        return total, last

    def count(self, word) -> int:
        return self.run(word)[0]

    def tokens(self, word) -> list[int]:
        """The encoding, its ids recovered backwards from the last tokens of the prefixes."""
        last, spell = self.run(word)[1], self.merges.spell
        out, at = [], len(word)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(spell[token]) if token >= 0 else 1
        return out[::-1]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level(path: str) -> tuple[MergeTable, list[str]]:
    """Merge table of a byte-level tokenizer file, and its added special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    stand_in = byte_alphabet()
    spell = {i: bytes(stand_in[c] for c in s) for s, i in vocab.items() if s not in added}
    split, rank, pair = {}, {}, {}
    for n, merge in enumerate(spec["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        token = vocab[left + right]
        pair[vocab[left], vocab[right]] = token
        split[token], rank[token] = (vocab[left], vocab[right]), n
    return MergeTable(spell, split, rank, lambda u, v: pair.get((u, v))), list(added)


def special_ids(path: str) -> dict[str, int]:
    """Ids of the added special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
