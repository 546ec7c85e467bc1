"""The four forms in which results are shown."""

from __future__ import annotations

import json
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import relative_path


class OutputMode(str, Enum):
    SHOW = "show"
    PATHS = "paths"
    JSON = "json"
    COUNT = "count"

    @property
    def for_machines(self) -> bool:
        return self in (OutputMode.JSON, OutputMode.PATHS)


def show_lines(results: DataFrame) -> DataFrame:
    """``label, score, line`` with one block of text for each result."""
    text = F.format_string("File: %s\nScore: %.4f\nChunk: %s", "file_path", "score", "chunk_text")
    return results.select("label", "score", text.alias("line"))


def paths(results: DataFrame, base: str | None = None) -> DataFrame:
    """Different paths in order, relative to ``base`` where they lie below it."""
    named = results.where("file_path is not null").select(relative_path(F.col("file_path"), base).alias("path"))
    return named.distinct().orderBy("path")


def json_lines(results: DataFrame) -> DataFrame:
    """``label, score, json``: each result as an object with all its fields, nulls too."""
    fields = F.struct("label", "score", "file_path", "chunk_text", "start_char_offset", "end_char_offset")
    return results.select("label", "score", F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def counts(results: DataFrame) -> DataFrame:
    """``chunks, files, text``: results, the different files they come from, and both in a sentence."""
    n = results.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("file_path").alias("files"))
    text = F.concat(F.lit(""), n["chunks"].cast("string"), F.lit(" matching "), F.when(n["chunks"] == 1, "chunk").otherwise("chunks"), F.lit(" in "), _plural(n["files"], "file"), F.lit("."))
    return n.select("chunks", "files", text.alias("text"))


def render(results: DataFrame, mode: OutputMode, base: str | None = None) -> str:
    """Results as printable text; a result set has at most k rows."""
    if mode is OutputMode.PATHS:
        return "\n".join(r["path"] for r in paths(results, base).collect()) or "No matching files found."
    if mode is OutputMode.JSON:
        return json.dumps([json.loads(r["json"]) for r in json_lines(results).orderBy(F.desc("score"), "label").collect()], indent=2, ensure_ascii=False)
    if mode is OutputMode.COUNT:
        return counts(results).first()["text"]
    found = show_lines(results).orderBy(F.desc("score"), "label").collect()
    return "\n\n".join([f"Top {len(found)} results:", *[r["line"] for r in found]]) if found else "No relevant chunks found."
