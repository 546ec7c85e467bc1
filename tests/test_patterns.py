import fnmatch
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.functions.patterns import glob_regex, ignored, keyword_like, names_match, parse_rules, path_like
from siftwell.functions.text import html_text, is_blank, is_blank_chunk, relative_path


@given(st.text("ab*?.[]!-", max_size=6), st.text("ab.[]!-", max_size=6))
def test_glob_as_fnmatch(glob, name):
    if "[" in glob:  # classes are compared below
        return
    assert bool(re.match(glob_regex(glob), name)) == fnmatch.fnmatchcase(name, glob)


@pytest.mark.parametrize("glob,yes,no", [("*.txt", "a.txt", "a.md"), ("[ab]*.py", "b1.py", "c1.py"), ("[!a].c", "b.c", "a.c"), ("a?c", "abc", "ac")])
def test_glob_classes(glob, yes, no):
    assert re.match(glob_regex(glob), yes) and not re.match(glob_regex(glob), no)


def test_ignore_rules_last_match_wins():
    rules = parse_rules("*.log\n    !important.log\n**/build/\n# no rule\n\n/top.txt\ndocs/*.md\n")
    for path, expected in {
        "a.log": True, "important.log": False, "x/important.log": False, "build/a.txt": True, "x/build/y/a.txt": True, "top.txt": True, "x/top.txt": False,
        "docs/a.md": True, "docs/x/a.md": False, "builder/a.txt": False,
    }.items():
        assert ignored(path, rules) is expected, path


def test_like_filters(spark):
    df = spark.createDataFrame([("/a/x.py", "Strong MATCH"), ("/a/y?.txt", "100% sure"), ("/b\\c.txt", None)], "p string, t string")
    assert [r.p for r in df.where(path_like(F.col("p"), ["/a/*.py", "/b\\*"])).collect()] == ["/a/x.py", "/b\\c.txt"]
    assert df.where(path_like(F.col("p"), ["/a/y?.txt"])).count() == 1  # ? is no wildcard
    assert df.where(keyword_like(F.col("t"), "match")).count() == 1
    assert df.where(keyword_like(F.col("t"), "s_re")).count() == 1  # _ is one
    assert path_like(F.col("p"), []) is None and keyword_like(F.col("t"), "") is None
    assert df.where(names_match(F.col("p"), ["*.py", "b*"])).count() == 2 - 0


def test_text_functions(spark):
    df = spark.createDataFrame([(" 　 \n",), ("​",), ("a",)], "t string")
    assert [r[0] for r in df.select(is_blank(F.col("t"))).collect()] == [True, False, False]
    assert [r[0] for r in df.select(is_blank_chunk(F.col("t"))).collect()] == [True, True, False]
    page = "<head><title>no</title></head><p>A &amp; B</p><script>x<y</script><!-- c --><b>C</b>"
    assert spark.range(1).select(html_text(F.lit(page))).first()[0] == "A & B C"
    row = spark.range(1).select(relative_path(F.lit("/r/a/b"), "/r"), relative_path(F.lit("/rx/b"), "/r"), relative_path(F.lit("/r/a"), None)).first()
    assert list(row) == ["a/b", "/rx/b", "/r/a"]
