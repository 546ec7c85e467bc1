"""All training texts and all different words teach the weights of the language model."""

import siftwell.llm.lm_scoring as lm


def test_every_training_row_teaches(spark, monkeypatch):
    taught, weights = [], lm._weights
    monkeypatch.setattr(lm, "_weights", lambda source, *rest: taught.append(source.count()) or weights(source, *rest))
    texts = [f"word{i} and word{i % 7} again" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lm.lm_scores(docs).collect()
    learnt = [t for t, r in zip(texts, sorted(rows, key=lambda r: r.doc_id), strict=True) if not r.held_out]
    assert taught == [len(learnt), len({w for t in learnt for w in t.split()})]
    assert 0 < len(learnt) < len(rows) == len(texts)
