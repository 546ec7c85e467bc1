import json

import pytest

from siftwell.operators.outputs import OutputMode, counts, paths, render
from siftwell.operators.searching import chunk_details, lookup, results

FILES = [(1, "/r/one.txt"), (2, "/r/sub/two.py"), (3, "/x/three.txt")]
CHUNKS = [(10, 1, "apples and KEYWORD", 0, 18, 3), (20, 2, "keyword only", 0, 12, 2), (21, 2, "bananas", 13, 20, 1)]


@pytest.fixture
def tables(spark):
    files = spark.createDataFrame(FILES, "file_id long, file_path string")
    chunks = spark.createDataFrame(CHUNKS, "label long, file_id long, chunk_text string, start_char_offset int, end_char_offset int, token_count int")
    return chunks, files


def test_details(spark, tables):
    labels = lambda *x: spark.createDataFrame([(i,) for i in x], "label long")
    got = lambda *a, **k: sorted(r.label for r in chunk_details(*tables, *a, **k).collect())
    assert got() == [10, 20, 21]
    assert got(labels(10, 99)) == [10] and got(labels()) == []
    assert got(paths=["*.py"]) == [20, 21] and got(paths=["*.py", "/r/*.txt"]) == [10, 20, 21]
    assert got(keyword="keyword") == [10, 20] and got(paths=["*.py"], keyword="KEY") == [20]
    assert lookup(*tables, 21).first().chunk_text == "bananas" and lookup(*tables, 5).count() == 0


def test_filters_come_after_the_best_k(spark, tables):
    hits = spark.createDataFrame([(10, 0.9), (21, 0.1), (20, 0.05)], "label long, score double")
    got = results(hits, *tables, min_score=0.1).collect()
    assert [r.label for r in got] == [10, 21]
    assert results(hits.where("label = 10"), *tables, paths=["*.py"]).count() == 0


def test_output_forms(spark, tables):
    hits = spark.createDataFrame([(10, 0.9), (20, 0.5), (21, 0.5)], "label long, score double")
    found = results(hits, *tables)
    assert render(found, OutputMode.PATHS) == "/r/one.txt\n/r/sub/two.py"
    assert render(found, OutputMode.PATHS, "/r") == "one.txt\nsub/two.py"
    assert render(found, OutputMode.COUNT) == "3 matching chunks in 2 files."
    shown = render(found, OutputMode.SHOW)
    assert shown.startswith("Top 3 results:") and "Score: 0.9000" in shown and "Chunk: bananas" in shown
    objects = json.loads(render(found, OutputMode.JSON))
    assert [list(o) for o in objects][0] == ["label", "score", "file_path", "chunk_text", "start_char_offset", "end_char_offset"] and [o["label"] for o in objects] == [10, 20, 21]
    none = found.where("label < 0")
    assert render(none, OutputMode.JSON) == "[]" and render(none, OutputMode.PATHS) == "No matching files found." and "No relevant" in render(none, OutputMode.SHOW)
    assert counts(found.limit(1)).first()["text"] == "1 matching chunk in 1 file."
    lost = spark.createDataFrame([(1, 0.5, None, None, None, None)], found.schema)
    assert json.loads(render(lost, OutputMode.JSON))[0]["file_path"] is None and paths(lost).count() == 0 and counts(lost).first()["files"] == 0
    assert OutputMode.JSON.for_machines and not OutputMode.COUNT.for_machines
