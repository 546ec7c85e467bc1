"""Exact deduplication with a heavy-hitter split.

A Misra-Gries pass finds the digests that may be frequent. Their exact counts and keepers are
then verified and broadcast, so rows of a hot group are decided where they lie; all other
digests take an ordinary shuffle, in which no group can be large any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import pinned, prepare, text_of

#: Share of rows above which a digest is sure to be found by the Misra-Gries pass. Its inverse
#: bounds the counters, and so the rows that are broadcast, whatever the input.
SUPPORT = 0.0005


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical byte for byte; of equal texts the row with the largest id stays.
    A null text counts as empty, so null and empty texts form one group. A null id sorts below
    every other id. When the same id occurs on several rows with equal text, one of those rows
    stays (``group_size`` counts them all). An empty table gives an empty result. Other columns,
    whatever their names, are not looked at.
    """
    prepare(docs.sparkSession)
    digests = pinned(
        docs.select(
            docs[id_col].alias("id"),
            F.sha2(F.encode(text_of(docs, text_col), "UTF-8"), 256).alias("digest"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    best = F.max(F.struct("id", "row")).alias("best")
    frequent = digests.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    winners = digests.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(best, F.count(F.lit(1)).alias("n"))
    winners = pinned(winners.where("n > 1"))

    split = digests.join(F.broadcast(winners), "digest", "left")
    hot = split.where(F.col("n").isNotNull())
    group = Window.partitionBy("digest")
    cold = split.where(F.col("n").isNull()).select(
        "digest", "id", "row", F.max(F.struct("id", "row")).over(group).alias("best"), F.count(F.lit(1)).over(group).alias("n")
    )
    return hot.select(cold.columns).unionByName(cold).select(
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; all columns stay as they are.

    Null and empty texts are one group, of which the row with the largest id stays; a null id is the
    smallest. Of rows that repeat an id with equal text any one stays. An empty table stays empty.
    """
    verdict = exact_dedup(docs, id_col, text_col, support).where("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
    digest = F.sha2(F.encode(text_of(docs, text_col), "UTF-8"), 256)
    tagged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs[id_col].alias("_id"), digest.alias("_digest"))
    joined = tagged.join(verdict, tagged["_id"].eqNullSafe(verdict["_keep"]) & (tagged["_digest"] == verdict["_sha"]), "left_semi")
    again = Window.partitionBy("_id", "_digest").orderBy(F.lit(0))
    return joined.withColumn("_n", F.row_number().over(again)).where("_n = 1").select("_doc.*")
