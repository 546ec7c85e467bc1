"""Encoding and decoding with a SentencePiece byte-pair model, without the library's encoder.

For each prefix of a word the last token of its encoding is stored, found by automaton matches and
pair-compatibility tests (:mod:`siftwell.llm.bpe`); ids are then recovered backwards. Words are
independent because no piece holds the space mark behind another character.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from siftwell.llm.bpe import MergeTable, PrefixAutomaton
from siftwell.llm.common import map_texts
from siftwell.llm.wordcache import WordCache

MARK = "▁"
_words = re.compile(f"(?<=[^{MARK}])(?={MARK})").split


def piece_merges(model) -> tuple[MergeTable, dict[int, int]]:
    """Merge table of the pieces that encoding can give, and the id of each fallback byte."""
    n = model.get_piece_size()
    text = {i: model.id_to_piece(i) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
    id_of = {s: i for i, s in text.items()}
    order = sorted((i for i in text if len(text[i]) > 1), key=lambda i: (-model.get_score(i), i))
    rank = {i: r for r, i in enumerate(order)}

    def join(u: int, v: int):
        return id_of.get(text[u] + text[v])

    spell, split = {}, {}
    for token, s in text.items():
        parts = [id_of.get(c, -1) for c in s]
        trees: dict[int, tuple[int, int]] = {}
        while len(parts) > 1 and -1 not in parts:
            best = min(((rank[m], k, m) for k in range(len(parts) - 1) if (m := join(parts[k], parts[k + 1])) is not None), default=None)
            if best is None:
                break
            _, k, made = best
            trees[made] = (parts[k], parts[k + 1])
            parts[k : k + 2] = [made]
        if parts == [token]:
            spell[token] = s
            if token in trees:
                split[token] = trees[token]
    return MergeTable(spell, split, rank, join), byte


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = model.eos_id()
        merges, self.byte = piece_merges(model)
        if any(MARK in s.lstrip(MARK) for s in merges.spell.values()):
            raise ValueError("a piece holds the space mark behind another character; words are not independent")
        if model.encode("a") == model.encode(" a") or model.decode(model.encode("a  a")) != "a  a":
            raise ValueError("only models that add a leading space and keep repeated spaces are supported")
        self.spell = merges.spell
        self.byte_of = {i: b for b, i in self.byte.items()}
        # a character outside the vocabulary stands alone; it is kept as a negative code until bytes are written
        self.automaton = PrefixAutomaton(merges, unknown=lambda c: -2 - ord(c))
        self.memo = WordCache(self.word)

    def ids(self, word: str) -> list[int]:
        out: list[int] = []
        for t in self.automaton.tokens(word):
            if t < 0:
                out.extend(self.byte[b] for b in chr(-2 - t).encode())
            else:
                out.append(t)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids`` of whole words, their marks as spaces."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.spell[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def word(self, part: str) -> tuple[str, str]:
        """Ids in decimal and decoded text of a word; ``part`` is the word behind its first mark."""
        ids = self.ids(MARK + part)
        return " ".join(map(str, ids)), self.decode(ids)

    def parts(self, text: str) -> list[str]:
        """Words of ``text`` without their first mark."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _words(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def code(self, text: str) -> tuple[str, str]:
        """All ids of ``text`` with the end id, in decimal with single spaces; and the decoded text."""
        found = self.memo.all(self.parts(text))
        if not found:
            return str(self.end), ""
        ids, texts = zip(*found, strict=True)
        return f"{' '.join(ids)} {self.end}", "".join(texts)[1:]


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, ids`` (with the end id) and ``decoded``. See :func:`piece_digests` for edge cases."""

    def worker():
        code = codec(path).code

        def work(texts: list[str]):
            both = [code(t) for t in texts]
            return None, [[[int(i) for i in ids.split(" ")] for ids, _ in both], [d for _, d in both]]

        return work

    return map_texts(docs, id_col, text_col, "ids array<int>, decoded string", worker)


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    A null text counts as empty and has the end id alone. Characters outside the vocabulary become
    byte pieces. Null ids and repeated rows pass through; an empty table gives an empty result;
    columns other than id and text are not looked at.
    """

    def worker():
        code, sha = codec(path).code, hashlib.sha256

        def work(texts: list[str]):
            n, a, b = [], [], []
            for t in texts:
                ids, decoded = code(t)
                n.append(ids.count(" ") + 1)
                a.append(sha(ids.encode()).hexdigest())
                b.append(sha(decoded.encode()).hexdigest())
            return None, [n, a, b]

        return work

    return map_texts(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", worker)
