"""Column expressions over texts and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero width space, non-joiner, joiner and no-break space, which do not make a chunk worth keeping.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
#: White space between the built-in tokenizer's tokens.
TOKEN_SPLIT = "[ \\t\\n\\r\\f]+"


#: Parts of a page that are not shown.
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->"


def is_blank(text: Column) -> Column:
    """Nothing but Unicode white space."""
    return F.length(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]", "")) == 0


def is_blank_chunk(text: Column) -> Column:
    """Nothing but white space and characters without width."""
    return is_blank(F.translate(text, ZERO_WIDTH, ""))


def tokens(text: Column) -> Column:
    """Tokens of the built-in tokenizer."""
    return F.filter(F.split(text, TOKEN_SPLIT), lambda t: t != "")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, head and comments go, then tags; common entities are decoded."""
    text = F.regexp_replace(html, HIDDEN, " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f]+", " "))


def relative_path(path: Column, base: str | None) -> Column:
    """``path`` below ``base``, or as it is when it lies elsewhere or no base is given."""
    if not base:
        return path
    inside = base.rstrip("/") + "/"
    return F.when(path.startswith(inside), F.substring(path, F.lit(len(inside) + 1), F.length(path))).otherwise(path)


def project_name(directory: Column) -> Column:
    """Lower-case name with spaces as hyphens."""
    return F.replace(F.lower(directory), F.lit(" "), F.lit("-"))
