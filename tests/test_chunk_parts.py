"""Windows leave a worker in parts of a bounded size, however long a text is."""

import pyarrow as pa

from siftwell.operators.chunking import HELD, WordChunker, cutter


def test_a_long_text_gives_windows_in_parts():
    names = ["file_path", "chunk_no", "chunk_text", "start_char_offset", "end_char_offset", "token_count"]
    text = "word " * 400_000
    parts = list(cutter(WordChunker(128, 20), names)([pa.RecordBatch.from_pydict({"file_path": ["/a", "/b"], "_text": [text, "one two"]})]))
    assert len(parts) > 2 and max(sum(map(len, p["chunk_text"].to_pylist())) for p in parts) < HELD + 128 * 5
    rows = pa.Table.from_batches(parts).to_pylist()
    whole = WordChunker(128, 20).chunk(text)
    assert [(r["chunk_no"], r["chunk_text"], r["start_char_offset"]) for r in rows] == [(n, c.text, c.start) for n, c in enumerate(whole)] + [(0, "one two", 0)]
    assert rows[-1]["file_path"] == "/b"
