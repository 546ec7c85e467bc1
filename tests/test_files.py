import os

import pytest

from siftwell.sources.extract import PlainExtractor, extract_file, file_hash
from siftwell.sources.files import gather, gather_all, read_files


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "top"
    for name in ("a.txt", "b.md", ".hidden.txt", "sub/c.txt", "sub/.h/d.txt", "node/x.txt"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(name)
    return top


def names(paths, root):
    return [p.relative_to(root.resolve()).as_posix() for p in paths]


def test_gather(tree, tmp_path):
    assert names(gather(tree), tree) == [".hidden.txt", "a.txt", "node/x.txt", "sub/.h/d.txt", "sub/c.txt"]
    assert names(gather(tree, ["*.md", "a.*"]), tree) == ["a.txt", "b.md"]
    assert gather(tree / "b.md", ["*.txt"]) == [(tree / "b.md").resolve()]
    (tree / ".gitignore").write_text("node/\n*.txt\n!c.txt\n")
    assert names(gather(tree), tree) == ["sub/c.txt"]
    (tree / ".gitignore").write_bytes(b"\xff\xfe\x00")
    assert len(gather(tree)) == 5
    os.remove(tree / ".gitignore")
    (tree / "sub/.gitignore").write_text("*")  # only the root's rules count
    assert len(gather(tree)) == 5
    other = tmp_path / "other.txt"
    other.write_text("o")
    (tree / "link.txt").symlink_to(other)
    (tree / "broken.txt").symlink_to(tmp_path / "gone")
    (tree / "loop").symlink_to(tree)
    got = gather(tree)
    assert other.resolve() in got and len(got) == 6


def test_several_roots(tree, tmp_path):
    said = []
    got = gather_all([tree, tree / "sub", tmp_path / "none"], warn=said.append)
    assert len(got) == 5 and len(said) == 1


def test_extraction(tmp_path):
    def text(raw, name="f.txt"):
        (tmp_path / name).write_bytes(raw)
        return extract_file(str(tmp_path / name))

    assert text(b"") == "" and text(b"PK\x03\x04zip") == "" and text("é".encode("latin-1")) == "é" and text(b"\xef\xbb\xbfx") == "x"
    assert text(b"<p>a<b>b</b></p><style>x</style>", "f.html").split() == ["a", "b"]
    assert len(text(b"one sentence here. " * 55_000)) > 1_000_000
    assert PlainExtractor({"bin": lambda raw: 1 / 0}).extract("a.bin", b"") == ""
    for bad in ("none", ""):
        with pytest.raises(FileNotFoundError):
            extract_file(str(tmp_path / bad))
    (tmp_path / "h").write_bytes(b"abc")
    assert file_hash(str(tmp_path / "h")).startswith("ba7816bf")
    with pytest.raises(FileNotFoundError):
        file_hash(str(tmp_path / "none"))


def test_reading(spark, tree):
    paths = gather(tree)
    got = {r.file_path: r for r in read_files(spark, [*paths, tree / "gone.txt"]).collect()}
    assert len(got) == 6 and got[str(tree / "gone.txt")].error and got[str(tree / "gone.txt")].content_hash is None
    a = got[str((tree / "a.txt").resolve())]
    assert (a.text, a.file_size_bytes, a.error) == ("a.txt", 5, None) and a.content_hash == file_hash(a.file_path)
    assert read_files(spark, []).count() == 0
