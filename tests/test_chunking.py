import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.operators.chunking import TokenizerChunker, WordChunker, chunked, labelled


@settings(max_examples=200)
@given(st.text(st.characters(exclude_categories=["Cs", "Cc"]), max_size=80), st.integers(1, 20), st.integers(0, 19))
def test_windows(text, size, overlap):
    if overlap >= size:
        with pytest.raises(ValueError):
            WordChunker(size, overlap)
        return
    chunker = WordChunker(size, overlap)
    n = len(chunker.spans(text))
    found = chunker.chunk(text)
    assert len(found) <= math.ceil(n / (size - overlap))
    for c in found:
        inside = [t for _, _, t in chunker.spans(text[c.start : c.end])]
        assert c.text == " ".join(inside) and c.tokens == len(inside) <= size


@pytest.mark.parametrize("size,overlap", [(0, 0), (-1, 0), (5, -1), (5, 5), (5, 6)])
def test_bad_geometry(size, overlap):
    with pytest.raises(ValueError):
        WordChunker(size, overlap)


def test_trailing_window_is_kept():
    assert [c.tokens for c in WordChunker(128, 20).chunk(" ".join(["w"] * 128))] == [128, 20]


@pytest.mark.parametrize("text", ["", "  \n", "​", "﻿ ‍"])
def test_blank_has_no_chunk(text):
    assert WordChunker().chunk(text) == []


def test_subword_windows():
    tokenizers = pytest.importorskip("public_tokenizers")
    found = TokenizerChunker(tokenizers.path("byte_bpe_50k.json"), 5, 2).chunk("An unbelievably long sentence about chunking things.")
    assert all(c.tokens <= 5 for c in found) and found[0].start == 0 and found[-1].text.endswith("things.")


def test_labels_follow_path_order(spark):
    rows = [(i, f"/d/{p}", "a b c d e " * n) for i, (p, n) in enumerate([("z", 3), ("a", 2), ("m", 0), ("b", 5)])]
    files = spark.createDataFrame([*rows, (9, "/d/n", None)], "file_id long, file_path string, text string")
    got = labelled(chunked(files, WordChunker(5, 0)), 10).orderBy("label").collect()
    assert [r.label for r in got] == list(range(10, 20))
    assert [(r.file_path, r.chunk_no) for r in got] == sorted((r.file_path, r.chunk_no) for r in got)
    assert labelled(chunked(files.limit(0))).count() == 0
