"""Settings and the TOML files that hold them."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

from siftwell.errors import ConfigError

#: The defaults of search and indexing.
DEFAULT_TOP, DEFAULT_CHUNK, DEFAULT_OVERLAP, DEFAULT_MIN_SCORE = 5, 128, 20, 0.1
DEFAULT_PATTERNS = ["*.txt"]
DEFAULT_MODEL = "hashed-terms-256"
MARKER = ".siftwell.toml"


@dataclass
class Config:
    """Global settings; chunk geometry is also recorded with every project and checked there."""

    home: Path = field(default_factory=lambda: Path.home() / ".siftwell")
    default_project: str = "default"
    embedding_model_name: str = DEFAULT_MODEL
    chunk_size: int = DEFAULT_CHUNK
    chunk_overlap: int = DEFAULT_OVERLAP

    @property
    def file(self) -> Path:
        return self.home / "config.toml"

    @property
    def catalog(self) -> Path:
        return self.home / "catalog"


def _plain(value):
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    return str(value) if isinstance(value, Path) else value


def _toml(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float):
        return str(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(_toml, value)) + "]"
    return '"' + str(value).replace("\\", "\\\\").replace('"', '\\"') + '"'


def write_toml(path: Path, values: dict) -> None:
    """A flat table as TOML; paths become strings."""
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"{k} = {_toml(v)}\n" for k, v in _plain(values).items()), encoding="utf-8")


def save_config(config: Config) -> None:
    write_toml(config.file, asdict(config))


def load_config(home: Path | None = None) -> Config:
    config = Config() if home is None else Config(home=Path(home))
    if not config.file.exists():
        raise ConfigError(f"no configuration at {config.file}; run 'init --global' first")
    try:
        found = tomllib.loads(config.file.read_text(encoding="utf-8"))
        return Config(**{k: Path(v) if k == "home" else v for k, v in found.items() if k in Config.__dataclass_fields__})
    except (tomllib.TOMLDecodeError, OSError, TypeError) as e:
        raise ConfigError(f"{config.file} cannot be read: {e}") from e


def project_of(root: Path) -> str | None:
    """Project named by the marker file of ``root``; None if it is missing, malformed or names none."""
    try:
        name = tomllib.loads((root / MARKER).read_text(encoding="utf-8")).get("project_name")
    except (OSError, tomllib.TOMLDecodeError):
        return None
    return name if isinstance(name, str) and name else None


def find_root(start: Path) -> Path | None:
    """Nearest folder at or above ``start`` that holds a marker file."""
    start = Path(start).resolve()
    return next((p for p in [start, *start.parents] if (p / MARKER).is_file()), None)
