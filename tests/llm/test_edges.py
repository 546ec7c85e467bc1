"""Every operator on the awkward rows: it runs, gives each row its result, and minds no other column."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftwell.llm import queries
from siftwell.llm.exact_dedup import exact_dedup, keep_one_each
from siftwell.llm.lines import fuzzy_lines
from siftwell.llm.lm_scoring import lm_scores
from siftwell.llm.packing import pack, sequences
from siftwell.llm.quality import quality_rules
from siftwell.llm.sentencepieces import encode_pieces, piece_digests
from siftwell.llm.simhash import keep_one_near, near_duplicates
from siftwell.llm.suffixes import repeated_passages, without_repeats
from siftwell.llm.token_counts import token_counts
from siftwell.llm.toxicity import Model, toxicity, train, without_toxic

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MODEL = Model({"idiot": 5.0}, [-3.0, 1.0, 1.0, -1.0, 1.0, 1.0])
BY_ROW = {
    "exact": exact_dedup,
    "tokens": lambda d: token_counts(d, BYTES),
    "pieces": lambda d: piece_digests(d, PIECES),
    "encoded": lambda d: encode_pieces(d, PIECES),
    "simhash": near_duplicates,
    "quality": quality_rules,
    "toxicity": lambda d: toxicity(d, MODEL),
    "lm": lm_scores,
}
OTHERS = {"passages": repeated_passages, "lines": fuzzy_lines, "pack": lambda d: pack(d, BYTES)}


def plain(df, without=()):
    columns = [c for c in df.columns if c not in without]
    return sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in (r[c] for c in columns)) for r in df.select(columns).collect())


@pytest.mark.parametrize("name", sorted(BY_ROW))
def test_one_row_each(docs, clashing, nothing, name):
    got = plain(BY_ROW[name](docs))
    assert len(got) == docs.count()
    assert plain(BY_ROW[name](clashing)) == got
    assert BY_ROW[name](nothing).count() == 0


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_other_shapes(docs, clashing, nothing, name):
    free = ("sequence_id", "offset")
    got = plain(OTHERS[name](docs), free)
    assert got and plain(OTHERS[name](clashing), free) == got and OTHERS[name](nothing).count() == 0


def test_filters_keep_columns(spark, docs, clashing, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1)], "doc_id long, toxic int")
    for keep in (keep_one_each, keep_one_near, without_repeats, lambda d: without_toxic(spark, d, labels)):
        kept = keep(clashing)
        assert kept.columns == clashing.columns and 0 < kept.count() <= clashing.count()
        assert keep(nothing).count() == 0 and keep(docs).columns == docs.columns


def test_exact_keeps_one_of_each_text(docs):
    n = docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert exact_dedup(docs).where("kept").count() == n and keep_one_each(docs).count() == n


def test_training_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(docs, train(docs, none)).where("predicted = 1").count() == 0


def test_sequences_hold_all_ids(docs):
    packed = pack(docs, BYTES, capacity=64, with_ids=True)
    whole = sequences(packed).select(F.size("ids").alias("n")).collect()
    assert max(r["n"] for r in whole) <= 64 and sum(r["n"] for r in whole) == packed.agg(F.sum("length")).first()[0]


def test_registered():
    assert [sum(n.startswith(f"op{i}_") for n in queries.queries()) for i in range(1, 11)] == [1] * 10
