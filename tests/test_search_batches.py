"""What a worker of a one-off search holds does not follow from the size of the table."""

from siftwell.functions.embedding import HashedTerms
from siftwell.operators.chunking import WordChunker
from siftwell.plans.engine import Engine


def files_of(spark, n):
    texts = [(i, f"/r/{'ab'[i % 2]}/{i % 7}-{i}.txt", " ".join(f"w{(i + j) % 5} common" for j in range(i % 40))) for i in range(n)]
    return spark.createDataFrame([*texts, (n, None, "common"), (n + 1, "/r/null.txt", None)], "file_id long, file_path string, text string").coalesce(1)


def test_texts_come_in_small_batches_and_the_best_are_the_same(spark):
    class FewAtATime(HashedTerms):
        def encode(self, texts, query=False):
            assert len(texts) <= 256, "too many texts at once"
            return super().encode(texts, query)

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files, engine = files_of(spark, 900), Engine(spark, chunker=WordChunker(8, 2), embedder=FewAtATime())
    got = engine.search_files(files, "common w3", 50, -1.0).collect()
    # ties are many, and go by label, as over labelled chunks
    want = engine.search_chunks(engine.indexed(files), files, "common w3", 50, -1.0).collect()
    assert got == want and len(got) == 50 and len({r.score for r in got}) < 10
