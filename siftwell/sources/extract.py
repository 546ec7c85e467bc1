"""Text extraction from file bytes."""

from __future__ import annotations

import html
import re
from typing import Protocol


class TextExtractor(Protocol):
    """Text of a file; an extractor that cannot parse the bytes gives an empty text."""

    def extract(self, path: str, raw: bytes) -> str: ...


class PlainExtractor:
    """Text and HTML files. Other formats plug in through ``by_suffix``: suffix to function of bytes."""

    def __init__(self, by_suffix: dict | None = None):
        self.by_suffix = by_suffix or {}

    @staticmethod
    def decode(raw: bytes) -> str:
        """UTF-8 with or without a mark, else Latin-1; bytes with zeros are no text."""
        if b"\x00" in raw or raw[:4] == b"PK\x03\x04":
            return ""
        try:
            return raw.decode("utf-8-sig")
        except UnicodeDecodeError:
            return raw.decode("latin-1")

    @staticmethod
    def visible(page: str) -> str:
        page = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ", page)
        page = html.unescape(re.sub(r"(?s)<[^>]*>", "\n", page))
        return "\n".join(filter(None, (" ".join(line.split()) for line in page.splitlines())))

    def extract(self, path: str, raw: bytes) -> str:
        suffix = path.rpartition(".")[2].lower() if "." in path else ""
        try:
            if suffix in self.by_suffix:
                return self.by_suffix[suffix](raw)
            text = self.decode(raw)
            return self.visible(text) if suffix in ("html", "htm") else text
        except Exception:  # noqa: BLE001  a file that cannot be parsed has no text, whatever its parser raised
            return ""


def extract_file(path: str, extractor: TextExtractor | None = None) -> str:
    """Text of one file; FileNotFoundError for a missing path or a folder."""
    from pathlib import Path

    if not Path(path).is_file():
        raise FileNotFoundError(path)
    return (extractor or PlainExtractor()).extract(path, Path(path).read_bytes())


def file_hash(path: str) -> str:
    """SHA-256 of a file in hex; FileNotFoundError if it is missing, OSError if it cannot be read."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
