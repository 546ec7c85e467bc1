import random
import zlib
from array import array

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import siftwell.llm.token_counts as token_counts
from siftwell.llm.packing import cut, ids_of, pack, plan
from siftwell.llm.sentencepieces import codec

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY, SPM = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
PARTS = [chr(c) for c in [*range(1, 0x250), 0x558, 0x3042, 0x4E00, 0x1F600, 0x2028, 0x2581, 0x85, 0xA0, 0x3000, 0x200B, 0xFEFF, 0x301, 0x10FFFF, 0xC5C]]
PARTS += ["'s", "'ll", "  ", "   ", "\n\n", " \n", "the", " of", "<|endoftext|>", "<|endof", "<s>", "</s>", "<0x0A>", " unbelievable"] * 15


def made(rng):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16)))


@pytest.mark.parametrize("span", [1, 3, 7, 1 << 16])
def test_counts(span, monkeypatch):
    monkeypatch.setattr(token_counts, "SPAN", span)
    counter, rng = token_counts.counter(BYTES), random.Random(span)
    for _ in range(1500):
        text = made(rng)
        assert counter.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    assert token_counts.counter(BYTES).count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)
    assert codec(PIECES).code(text) == (" ".join(map(str, SPM.encode(text, add_eos=True))), SPM.decode(SPM.encode(text, add_eos=True)))


def test_pieces_and_ids():
    rng = random.Random(5)
    for _ in range(3000):
        text = made(rng)
        ids = SPM.encode(text, add_eos=True)
        assert codec(PIECES).code(text) == (" ".join(map(str, ids)), SPM.decode(ids)), text
        assert list(array("I", ids_of(BYTES).of(text))) == LIBRARY.encode(text, add_special_tokens=False).ids, text


def test_automaton_beyond_its_table(monkeypatch):
    import siftwell.llm.bpe as bpe

    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    fresh, rng = token_counts.TokenCounter(BYTES), random.Random(6)
    for _ in range(500):
        text = made(rng)
        assert fresh.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids), text


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=20))
def test_plan_fills_without_overlap(histogram):
    runs, places, number = plan(histogram, 30), {}, dict.fromkeys(histogram, 0)
    for r in runs:
        assert r.first == number[r.length]
        number[r.length] += r.n
        for i in range(r.n):
            places.setdefault(r.sequence + i // r.each, []).append((r.offset + i % r.each * r.length, r.length))
    assert number == histogram and sorted(places) == list(range(len(places)))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 30
        assert sum(3 * n > 30 for _, n in own) <= 2
    total = sum(n * k for n, k in histogram.items())
    large = sum(k for n, k in histogram.items() if 2 * n > 30)
    assert len(places) <= max(large, 1.5 * total / 30 + 1)


def test_cut():
    assert cut(2048) == [(0, 2048)] and cut(2049) == [(0, 1), (1, 2048)] and cut(4096) == [(0, 2048), (2048, 2048)] and cut(1) == [(0, 1)]


def test_pack_against_library(docs):
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id is not null").collect()}
    rows = [r for r in pack(docs, BYTES).collect() if r.doc_id is not None and r.doc_id != 150]
    for doc_id in {r.doc_id for r in rows}:
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        ids = LIBRARY.encode(texts[doc_id], add_special_tokens=False).ids + [0]
        assert sum(r.length for r in own) == len(ids) and [r.start for r in own] == [s for s, _ in cut(len(ids))]
        for r in own:
            assert r.ids_crc32 == zlib.crc32(array("I", ids[r.start : r.start + r.length]).tobytes())
