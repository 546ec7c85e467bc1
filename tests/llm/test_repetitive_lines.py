"""Long lines of few shingles meet short ones in large buckets, and bands miss hardly a pair at the threshold."""

from siftwell.llm import lines


def test_ruling_meets_a_short_line():
    texts = ["abcdefghij" * 40, "-" * 20, "abcdefghijabcd"]
    assert lines.shingles(texts[0]) == lines.shingles(texts[2])
    assert {tuple(sorted(e)) for e in lines.link_lines([1, 2, 3], texts, [1, 2, 3])} == {(1, 3)}


def test_bands_at_the_threshold():
    assert (1 - lines.LEAST**lines.ROWS) ** lines.BANDS < 0.001 and 1 << lines.BAND_BITS >= lines.BANDS
