"""Globs, ignore rules and LIKE patterns as column expressions and regular expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An escape character that no pattern holds, so that LIKE takes backslashes literally.
NO_ESCAPE = "\u0001"


def _glob_piece(glob: str, at: int, star: str, mark: str) -> tuple[str, int]:
    """Regular expression for what begins at ``at``, and where the next piece begins."""
    c = glob[at]
    if c == "*":
        return star, at + 1
    if c == "?":
        return mark, at + 1
    if c == "[":
        end = glob.find("]", at + 2 if glob[at + 1 : at + 2] in ("!", "^", "]") else at + 1)
        if end > at:
            body = glob[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            body = "^" + body[1:] if body[:1] == "!" else ("\\^" + body[1:] if body[:1] == "^" else body)
            return f"[{body}]", end + 1
    return re.escape(c), at + 1


def glob_regex(glob: str) -> str:
    """Regular expression of a file-name glob, for the whole name; ``*`` also crosses separators."""
    out, at = "", 0
    while at < len(glob):
        piece, at = _glob_piece(glob, at, "(?s:.*)", "(?s:.)")
        out += piece
    return f"^{out}$"


def names_match(path: Column, globs: list[str]) -> Column:
    """Whether the last part of ``path`` matches any glob; globs are case-sensitive."""
    name = F.element_at(F.split(path, "/"), -1)
    return name.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def rule_regex(rule: str) -> str:
    """Regular expression of one ignore rule over a relative path of a file, without ``!``."""
    only_folders = rule.endswith("/")
    body = rule.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, at = "", 0
    while at < len(body):
        if body.startswith("**/", at) and (at == 0 or body[at - 1] == "/"):
            out += "(?:.*/)?"
            at += 3
        elif body.startswith("**", at) and (at == 0 or body[at - 1] == "/") and at + 2 == len(body):
            out += ".*"
            at += 2
        else:
            piece, at = _glob_piece(body, at, "[^/]*", "[^/]")
            out += piece
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if only_folders else "(?:/.*)?$")


def parse_rules(text: str) -> list[tuple[bool, str]]:
    """(ignore, regular expression) of every rule in order; comments and blank lines are none."""
    found = []
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            keep = line.startswith("!")
            body = line[1:] if keep else line.removeprefix("\\")
            if body.strip("/"):
                found.append((not keep, rule_regex(body)))
    return found


def ignored(relative: str, rules: list[tuple[bool, str]]) -> bool:
    """Whether the last matching rule ignores ``relative``."""
    return next((ignore for ignore, regex in reversed(rules) if re.match(regex, relative)), False)


def ignored_column(relative: Column, rules: list[tuple[bool, str]]) -> Column:
    """:func:`ignored` as an expression."""
    tests = [F.when(relative.rlike(regex), F.lit(ignore)) for ignore, regex in reversed(rules)]
    return F.coalesce(*tests, F.lit(False))


def path_like(path: Column, patterns: list[str] | None) -> Column | None:
    """Any of ``patterns`` over the whole path: only ``*`` is translated, ``%`` and ``_`` stay wildcards. None without patterns."""
    if not patterns:
        return None
    return reduce(lambda a, b: a | b, [F.like(path, F.lit(p.replace("*", "%")), F.lit(NO_ESCAPE)) for p in patterns])


def keyword_like(text: Column, keyword: str | None) -> Column | None:
    """Case-insensitive substring test in which ``%`` and ``_`` are wildcards. None without a keyword."""
    if not keyword:
        return None
    return F.like(F.lower(text), F.lower(F.lit(f"%{keyword}%")), F.lit(NO_ESCAPE))
