"""Quality rules whose thresholds adapt to each language and source.

Every document gets a few ratios. Mergeable quantile sketches (KLL) of those ratios per language and
source say what is usual there: the median, and how far a high quantile lies from it. Small groups lean
on the merged sketch of all documents. The fences that follow, a table of one row per group, are joined
back and decide. Fixed cutoffs remain only for what no corpus would call usual text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import WORD_SPLIT, pinned, prepare, text_of

SPACE = " \t\n\x0b\x0c\r"
#: Items a sketch keeps; below that many rows in a group its quantiles are exact.
SKETCH_K = 4096
#: So many documents of the whole corpus count beside a group's own.
PRIOR = 200
#: Fences lie so many times as far from the median as the high quantile does.
REACH = 4.0
#: Ratio -> (high quantile, what it counts by, whether low values are also refused). Documents that are rarely zero in
#: a ratio need no higher one than 0.9; lines and words repeat in few sound documents.
RATIOS = {
    "chars_per_word": (0.9, "n_words", True),
    "symbols_per_word": (0.9, "n_words", False),
    "dup_line_share": (0.98, "n_lines", False),
    "repeat_share": (0.95, "n_words", False),
}
#: Up to so many different repeated windows a text is scanned for each; with more its windows are sorted.
FEW = 24
#: Group tables up to this many rows are broadcast; larger ones are joined with salted keys.
BROADCAST_ROWS = 50_000
SALTS = 32


def _words(text: Column) -> Column:
    inner = F.trim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_SPLIT))


def _covered(starts: Column) -> Column:
    """Words in the union of three-word windows that begin at ``starts``, given in ascending order."""
    total = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(3), p - acc["at"])).alias("n")),
    )
    return total["n"]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of every document: ``doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``.

    Windows of a text are told apart by a 64-bit hash of their words.
    """
    text = text_of(docs, text_col)
    base = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].alias("lang"), docs[source_col].alias("source"), text.alias("text"))
    cut = base.select(
        "doc_id", "lang", "source", _words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.trim(line, F.lit(SPACE)) != "").alias("lines"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).alias("n_symbols"),
    )
    hashes = F.transform(
        F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
    )
    hashed = cut.select("*", hashes.alias("hashes")).select("*", F.sort_array("hashes").alias("ordered"))
    repeated = F.array_distinct(F.filter("ordered", lambda h, i: F.coalesce(h == F.get("ordered", i - 1), F.lit(False))))
    ordered = hashed.select("*", repeated.alias("repeated")).drop("ordered")

    few = F.filter(F.transform("hashes", lambda h, i: F.when(F.array_contains("repeated", h), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    placed = ordered.select("*", F.when(F.size("repeated") > FEW, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))).alias("placed"))

    def twice(w: Column, i: Column) -> Column:
        same = [F.coalesce(w["h"] == F.get("placed", i + d)["h"], F.lit(False)) for d in (-1, 1)]
        return same[0] | same[1]

    many = F.sort_array(F.transform(F.filter("placed", twice), lambda w: w["at"]))
    starts = F.when(F.size("repeated") == 0, F.array().cast("array<int>")).when(F.size("repeated") <= FEW, few).otherwise(many)
    return placed.select("*", starts.alias("starts")).select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("starts")).cast("long").alias("n_repeat_words"),
    )


def _ratio(name: str) -> Column:
    words = F.nullif(F.col("n_words"), F.lit(0))
    return {
        "chars_per_word": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)),
        "repeat_share": F.col("n_repeat_words") / words,
    }[name]


def fences(measured: DataFrame) -> DataFrame:
    """Fences per language and source, from sketches of the documents that pass the fixed rules.

    A fence lies at the median and ``REACH`` times the distance to the high quantile, but at least
    ``REACH`` times what one word or line more makes in a document of median size. All quantiles are
    means of the group's and the corpus's, weighed by the group's documents and ``PRIOR``.
    """
    columns = [*RATIOS, "n_words", "n_lines"]
    usual = measured.where(~F.col("base_failed")).select(
        "lang", "source", *[_ratio(r).alias(r) for r in RATIOS], *[F.col(c).cast("double").alias(c) for c in ("n_words", "n_lines")]
    )
    own = usual.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(c, SKETCH_K).alias(c) for c in columns])
    own = pinned(own)
    every = own.agg(*[F.kll_merge_agg_double(c, SKETCH_K).alias(f"all_{c}") for c in columns])
    both = own.crossJoin(F.broadcast(every))  # one row

    def quantile(c: str, q: float) -> Column:
        mine, alls = (F.kll_sketch_get_quantile_double(x, F.lit(q)) for x in (c, f"all_{c}"))
        return (F.col("n") * mine + PRIOR * alls) / (F.col("n") + PRIOR)

    wanted = {(c, 0.5) for c in columns} | {(r, q) for r, (q, _, _) in RATIOS.items()} | {(r, 1 - q) for r, (q, _, low) in RATIOS.items() if low}
    name = {(c, q): f"{c}_{round(100 * q)}" for c, q in wanted}
    found = both.select("lang", "source", *[quantile(c, q).alias(n) for (c, q), n in sorted(name.items())])
    limits = []
    for r, (high, unit, two_sided) in RATIOS.items():
        middle, step = F.col(name[r, 0.5]), 1 / F.col(name[unit, 0.5])
        limits.append((middle + REACH * F.greatest(F.col(name[r, high]) - middle, step)).alias(f"{r}_max"))
        limits.append((middle - REACH * F.greatest(middle - F.col(name[r, 1 - high]), step) if two_sided else F.lit(float("-inf"))).alias(f"{r}_min"))
    return found.select("lang", "source", *limits)


def _with_fences(measured: DataFrame, table: DataFrame) -> DataFrame:
    """``measured`` left-joined with its group's fences; a hot group is met where it lies or salted."""
    table = table.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *[c for c in table.columns if c not in ("lang", "source")])
    same = measured["lang"].eqNullSafe(table["f_lang"]) & measured["source"].eqNullSafe(table["f_source"])
    if table.count() <= BROADCAST_ROWS:
        return measured.join(F.broadcast(table), same, "left")
    salted = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("f_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = salted["lang"].eqNullSafe(copies["f_lang"]) & salted["source"].eqNullSafe(copies["f_source"]) & (salted["salt"] == copies["f_salt"])
    return salted.join(copies, same, "left")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    A null text has no words and fails the fixed rules; null languages and sources form groups of
    their own; a small group leans on all documents; one with no usable document has none to judge.
    Repeated rows are judged alike and each returned; an empty table gives an empty result; other
    columns are not looked at.
    """
    prepare(docs.sparkSession)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = pinned(measures(docs, id_col, text_col, lang_col, source_col).withColumn("base_failed", failed))
    judged = _with_fences(measured, pinned(fences(measured)))
    inside = F.lit(True)
    for r in RATIOS:
        inside &= F.coalesce((_ratio(r) >= F.col(f"{r}_min")) & (_ratio(r) <= F.col(f"{r}_max")), F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept")
    )
