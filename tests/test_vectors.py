import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.errors import VectorStoreError
from siftwell.functions.embedding import HashedTerms, PromptedModel
from siftwell.operators.vectors import ExactIndex, check_vectors, nearest, nearest_of_many, scores


@pytest.fixture
def index(spark):
    return ExactIndex.empty(spark, 3).add([10, 20, 30], np.eye(3))


def test_self_search(index):
    got = index.search(np.eye(3)[0], 2).collect()
    assert got[0].label == 10 and got[0].score == pytest.approx(1, abs=1e-5) and len(got) == 2 and len(index) == 3


@pytest.mark.parametrize("metric,expected", [("ip", {10: 1.0, 20: 0.5}), ("l2sq", {10: 1.0, 20: 1 / 1.25}), ("cos", {10: 1.0, 20: 1.0}), ("haversine", {10: 0.0, 20: -0.25})])
def test_metrics(spark, metric, expected):
    index = ExactIndex.empty(spark, 2, metric).add([10, 20], [[1, 0], [0.5, 0]])
    assert {r.label: r.score for r in index.search([1, 0], 5).collect()} == pytest.approx(expected)


def test_edges(spark, index):
    assert index.search([1, 0, 0], 99).count() == 3
    assert ExactIndex.empty(spark, 3).search([1, 0, 0], 2).count() == 0
    assert index.search([0, 0, 0], 3).first().score == 0
    for bad in (lambda: index.search([1, 0, 0], 0), lambda: index.search([1, 0], 1), lambda: index.search(np.eye(3), 1), lambda: index.add([1], np.eye(3)), lambda: index.add([1], [1, 2, 3])):
        with pytest.raises(ValueError):
            bad()
    assert index.add([], np.zeros((0, 3))) is index
    left = index.remove(spark.createDataFrame([(20,), (77,)], "label long"))
    assert sorted(r.label for r in left.keys().collect()) == [10, 30]
    with pytest.raises(Exception, match="3 dimensions"):
        check_vectors(spark.createDataFrame([(1, [1.0])], "label long, embedding array<float>"), 3).collect()


def test_save_and_load(spark, index, tmp_path):
    path = str(tmp_path / "deep/v")
    index.save(path)
    index.save(path)
    assert len(ExactIndex.load(spark, path, 3)) == 3 and [p.name for p in (tmp_path / "deep").iterdir()] == ["v"]
    with pytest.raises(FileNotFoundError):
        ExactIndex.load(spark, str(tmp_path / "none"), 3)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/part-0.parquet").write_bytes(b"no vectors")
    with pytest.raises(VectorStoreError):
        ExactIndex.load(spark, str(tmp_path / "bad"), 3)


@settings(max_examples=60)
@given(st.integers(1, 5), st.integers(1, 8), st.randoms(use_true_random=False))
def test_scores_bounded(n, d, random):
    v = np.array([[random.uniform(-1, 1) for _ in range(d)] for _ in range(n)])
    assert (np.abs(scores(v, v[:1], "cos")) <= 1 + 1e-6).all()


def test_many_queries_equal_single_ones(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4)).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "label long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(5)], "query_id long, query array<float>")
    got = nearest_of_many(table, queries, 4).collect()
    for q in range(5):
        own = [(r.label, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert own == [(r.label, r.score) for r in nearest(table, v[q], 4).collect()]


def test_embedders():
    e = HashedTerms()
    assert e.encode(["A b a", ""]).sum(axis=1).tolist() == [3, 0] and (e.encode(["É x"]) == e.encode(["é X"])).all()

    class Fake:
        def encode(self, texts, prompt_name=None):
            return np.full((len(texts), 2), 1.0 if prompt_name == "query" else 0.0)

    assert PromptedModel("Qwen3", lambda n: Fake()).encode(["x"], query=True).sum() == 2
    assert PromptedModel("other", lambda n: Fake()).encode(["x"], query=True).sum() == 0
    assert PromptedModel("other", lambda n: Fake()).encode([]).shape == (0, 2)
