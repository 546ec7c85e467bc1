import os

import pytest

from siftwell.errors import ConfigError, IndexerError
from siftwell.operators.chunking import WordChunker
from siftwell.plans.engine import Engine
import siftwell.sources.snapshots as snapshots
from siftwell.sources.snapshots import MAX_LABEL, Store, read_pointer, write_pointer
from siftwell.streaming.arrivals import arriving, index_arrivals


@pytest.fixture
def engine(spark):
    return Engine(spark, chunker=WordChunker(4, 1))


def test_life_of_an_index(engine, tmp_path):
    docs, store = tmp_path / "docs", engine.open(str(tmp_path / "store"))
    docs.mkdir()
    for name, text in {"a.txt": "apples are red and round", "b.txt": "bananas are yellow", "empty.txt": "", "n.md": "notes on apples"}.items():
        (docs / name).write_text(text)
    assert engine.index(store, [str(docs)]) == (3, 3, 0)
    assert store.counts() == (3, 3) and store.max_label() == 2
    assert engine.index(store, [str(docs)]) == (3, 0, 0) and store.max_label() == 2
    before = {r.file_path: r.file_id for r in store.files.collect()}
    (docs / "a.txt").write_text("cherries")
    os.remove(docs / "b.txt")
    (docs / "c.txt").write_text("dates and apples")
    assert engine.index(store, [str(docs)]) == (3, 2, 0)
    assert sorted(r.label for r in store.chunks.collect()) == [3, 4]
    after = {r.file_path: r.file_id for r in store.files.collect()}
    assert len(after) == 3 and set(after.values()) & set(before.values()) == {before[str(docs.resolve() / "empty.txt")]}
    assert engine.search_project(store, "apples", k=1, min_score=0.1).first().file_path.endswith("c.txt")
    assert engine.index(store, [str(docs)], ["*.md"]) == (1, 1, 0)  # another pattern prunes what it does not match
    assert [r.label for r in store.chunks.collect()] == [5]
    assert engine.index(store, [str(docs)], rebuild=True) == (3, 2, 0)
    assert sorted(r.label for r in store.chunks.collect()) == [6, 7]  # labels go on
    assert engine.index(store, [str(tmp_path / "gone")]) == (0, 0, 0) and store.counts() == (0, 0)
    assert engine.search_project(store, "apples").count() == 0
    assert len(list((tmp_path / "store").glob("snapshot-*"))) == 2  # the one before stays for readers
    with pytest.raises(IndexerError):
        engine.index(store, [])


def test_unreadable_file_is_an_error(engine, tmp_path, spark):
    store = engine.open(str(tmp_path / "s"))
    from siftwell.plans.sync import sync
    from siftwell.sources.files import read_files

    (tmp_path / "x.txt").write_text("x")
    assert sync(store, read_files(spark, [tmp_path / "x.txt", tmp_path / "gone.txt"]), WordChunker(4, 1)) == (1, 1, 1)


def test_geometry_is_recorded(engine, spark, tmp_path):
    engine.open(str(tmp_path / "s"))
    with pytest.raises(ConfigError, match="chunk_size"):
        Engine(spark, chunker=WordChunker(8, 1)).open(str(tmp_path / "s"))


def test_failed_commit_leaves_the_old_state(engine, spark, tmp_path):
    store = engine.open(str(tmp_path / "s"))
    pointer = read_pointer(spark, store.path)
    with pytest.raises(Exception):
        store.commit(files=store.files.selectExpr("*", "1 AS x").drop("file_path"))
    assert read_pointer(spark, store.path) == pointer and len(list((tmp_path / "s").glob("snapshot-*"))) == 1


class Killed(BaseException):
    """Ends a commit as the death of the driver would: nothing is cleaned up."""


@pytest.mark.parametrize("step", ["_rename", "_pointers", "write_pointer", "delete"])
def test_killed_commit_leaves_a_whole_state(engine, spark, tmp_path, monkeypatch, step):
    """Whatever step a commit dies in, the store opens with the old rows or the new ones."""
    (tmp_path / "a.txt").write_text("apples are red")
    store = engine.open(str(tmp_path / "s"))
    for text in ("apples are red", "apples are green"):
        (tmp_path / "a.txt").write_text(text)
        engine.index(store, [str(tmp_path / "a.txt")])

    def dies(*_):
        raise Killed

    (tmp_path / "a.txt").write_text("pears")
    with monkeypatch.context() as m:
        m.setattr(snapshots, step, dies)
        try:
            engine.index(store, [str(tmp_path / "a.txt")])
        except Killed:
            pass
    again = engine.open(str(tmp_path / "s"))
    assert [r.chunk_text for r in again.chunks.collect()] in (["apples are green"], ["pears"]) and again.counts() == (1, 1)
    engine.index(again, [str(tmp_path / "a.txt")])
    assert [r.chunk_text for r in again.chunks.collect()] == ["pears"]


def test_rebuild_changes_geometry_in_one_commit(engine, spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("one two three four five six seven eight")
    store = engine.open(str(tmp_path / "s"))
    engine.index(store, [str(tmp_path / "a.txt")])
    other, commits = Engine(spark, chunker=WordChunker(8, 0)), []
    commit = Store.commit
    monkeypatch.setattr(Store, "commit", lambda self, **t: commits.append(1) or commit(self, **t))
    other.index(other.open(str(tmp_path / "s"), rebuild=True), [str(tmp_path / "a.txt")], rebuild=True)
    assert commits == [1] and [r.token_count for r in other.open(str(tmp_path / "s")).chunks.collect()] == [8]
    with pytest.raises(ConfigError):
        engine.open(str(tmp_path / "s"))


def test_unchanged_files_are_not_parsed(spark, tmp_path):
    class Once:
        def extract(self, path, raw):
            if b"parsed" in raw:
                raise AssertionError(path)
            return raw.decode()

    for name, text in (("a.txt", "first"), ("b.txt", "second")):
        (tmp_path / name).write_text(text)
    engine = Engine(spark, extractor=Once())
    store = engine.open(str(tmp_path / "s"))
    assert engine.index(store, [str(tmp_path)], ["*.txt"]) == (2, 2, 0)
    (tmp_path / "b.txt").write_text("third")

    class OnlyThird(Once):
        def extract(self, path, raw):
            assert raw == b"third"
            return raw.decode()

    assert Engine(spark, extractor=OnlyThird()).index(store, [str(tmp_path)], ["*.txt"]) == (2, 1, 0)


def test_key_values(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.max_label() is None
    store.commit(key_values=spark.createDataFrame([(MAX_LABEL, "x")], "key string, value string"))
    assert store.max_label() is None and store.value(MAX_LABEL) == "x"
    for value in ("é", "ü"):
        write_pointer(spark, str(tmp_path / "f"), {"v": value})
    assert read_pointer(spark, str(tmp_path / "f")) == {"v": "ü"}
    (tmp_path / "f" / "CURRENT-00000009").write_text("{broken")
    assert read_pointer(spark, str(tmp_path / "f")) == {"v": "ü"} and read_pointer(spark, str(tmp_path / "none")) is None


def test_one_off_search(engine, tmp_path):
    (tmp_path / "one.txt").write_text("apples bananas")
    (tmp_path / "two.txt").write_text("bananas oranges")
    (tmp_path / "blank.txt").write_text("  ")
    got = engine.search_path(tmp_path, "oranges", k=5, min_score=0.1).collect()
    assert [r.file_path.rpartition("/")[2] for r in got] == ["two.txt"]
    assert engine.search_path(tmp_path, "apples", k=1, paths=["*two.txt"]).count() == 0


def test_arrivals(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("first text")
    store = Store(spark, str(tmp_path / "s"))
    for expected, name in ((1, "b.txt"), (2, "c.txt")):
        index_arrivals(store, arriving(spark, str(folder)), str(tmp_path / "cp")).awaitTermination()
        assert store.counts()[0] == expected
        (folder / name).write_text("more text")
