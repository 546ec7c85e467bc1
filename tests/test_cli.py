import json
import tomllib

import pytest

from siftwell.catalog import Catalog, active_project, init_global
from siftwell.cli import main
from siftwell.config import Config, find_root, load_config, project_of, write_toml
from siftwell.errors import ConfigError, MetadataError


@pytest.fixture
def home(spark, tmp_path):
    init_global(spark, tmp_path / "home")
    return tmp_path / "home"


def test_config(tmp_path, home):
    config = load_config(home)
    assert config.home == home and config.chunk_size == 128
    write_toml(tmp_path / "t.toml", {"a": tmp_path, "b": [1, "x\"y"], "c": True})
    assert tomllib.loads((tmp_path / "t.toml").read_text()) == {"a": str(tmp_path), "b": [1, 'x"y'], "c": True}
    config.file.write_text("= broken")
    with pytest.raises(ConfigError):
        load_config(home)
    with pytest.raises(ConfigError):
        load_config(tmp_path / "none")
    assert project_of(tmp_path) is None
    (tmp_path / ".siftwell.toml").write_text("project_name = 'p'")
    (tmp_path / "x/y").mkdir(parents=True)
    assert find_root(tmp_path / "x/y") == tmp_path.resolve() and active_project(config, None, tmp_path / "x") == "p" and active_project(config, "q", tmp_path) == "q"
    (tmp_path / ".siftwell.toml").write_text("other = 1")
    assert project_of(tmp_path) is None and active_project(config, None, tmp_path) == "default"


def test_catalog(spark, home, tmp_path):
    catalog = Catalog(spark, load_config(home))
    assert catalog.names() == ["default"] and catalog.get("none") is None
    catalog.create("a", [str(tmp_path)])
    catalog.add_path("a", str(tmp_path))
    assert catalog.get("a").paths == [str(tmp_path.resolve())] and catalog.get("default").paths == [] and catalog.names() == ["a", "default"]
    with pytest.raises(MetadataError):
        catalog.create("a")
    with pytest.raises(MetadataError):
        catalog.add_path("none", "/")
    with pytest.raises(ConfigError):
        init_global(spark, home)
    init_global(spark, home, overwrite=True)
    assert catalog.names() == ["a", "default"]


def test_commands(home, tmp_path, monkeypatch, capsys):
    def call(*args, ok=0):
        assert main(["--home", str(home), *args]) == ok
        return capsys.readouterr().out.strip()

    docs = tmp_path / "My Docs"
    docs.mkdir()
    (docs / "fruit.txt").write_text("apples and bananas")
    (docs / "code.py").write_text("apples = 1")
    monkeypatch.chdir(docs)
    assert "my-docs" in call("init")
    call("init", ok=1)
    assert "no index" in call("status")
    assert "1 files processed, 1 chunks indexed, 0 errors" in call("index")
    assert "1 files, 1 chunks" in call("status")
    assert call("search", "apples", "-o", "paths", "--relative-paths") == "fruit.txt"
    assert "1 matching chunk in 1 file." == call("search", "apples", str(docs), "-o", "count")
    assert len(json.loads(call("search", "apples", str(docs), "-p", "*.py", "-p", "*.txt", "-o", "json"))) == 2
    assert json.loads(call("search", "apples", str(docs), "-p", "*.none", "-o", "json")) == []
    assert call("search", "zebra", "-o", "json", "--min-score", "0.9") == "[]"
    assert "2 files processed" in call("index", "--rebuild", "--yes", "-p", "*.txt", "-p", "*.py", "--workers", "2")
    call("project", "create", "other")
    call("project", "create", "other", ok=1)
    call("project", "add-path", str(tmp_path), "--project", "other")
    assert call("project", "list") == "default\nmy-docs\nother"
    assert "no paths" in call("index", "--project", "default")
    call("search", "x", "--project", "none", ok=1)
    call("search", "x", str(tmp_path / "gone"), ok=1)
    for bad in (["search", "x", "--top", "0"], ["search", "x", "--min-score", "2"], []):
        with pytest.raises(SystemExit):
            main(bad)
    with pytest.raises(SystemExit) as done:
        main(["--version"])
    assert done.value.code == 0 and Config().default_project == "default"
