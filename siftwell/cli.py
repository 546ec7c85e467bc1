"""Command line: search, index, status, project, init."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from siftwell import __version__
from siftwell.catalog import Catalog, active_project, init_global, init_local
from siftwell.config import DEFAULT_MIN_SCORE, DEFAULT_TOP, Config, load_config
from siftwell.errors import ConfigError, SiftwellError
from siftwell.operators.chunking import WordChunker
from siftwell.operators.outputs import OutputMode, render
from siftwell.plans.engine import Engine
from siftwell.session import build_session
from siftwell.sources.files import gather
from siftwell.sources.snapshots import Store


def _share(value: str) -> float:
    number = float(value)
    if not 0 <= number <= 1:
        raise argparse.ArgumentTypeError("must lie between 0 and 1")
    return number


def _positive(value: str) -> int:
    number = int(value)
    if number < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return number


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siftwell", description="Semantic search over document collections.")
    top.add_argument("--version", action="version", version=f"siftwell {__version__}")
    top.add_argument("--home", type=Path, default=None, help="folder of configuration and catalog")
    commands = top.add_subparsers(dest="command", required=True)

    search = commands.add_parser("search", help="search a path once, or a project")
    search.add_argument("query")
    search.add_argument("path", nargs="?", type=Path)
    search.add_argument("--pattern", "-p", action="append")
    search.add_argument("--output", "-o", type=OutputMode, choices=list(OutputMode), default=OutputMode.SHOW, metavar="{show,paths,json,count}")
    search.add_argument("--top", "--k", dest="top", type=_positive, default=DEFAULT_TOP)
    search.add_argument("--relative-paths", action="store_true")
    search.add_argument("--project")
    search.add_argument("--file-filter", action="append", help="applied after the best results are taken")
    search.add_argument("--keyword")
    search.add_argument("--min-score", type=_share, default=DEFAULT_MIN_SCORE)

    index = commands.add_parser("index", help="bring a project's index up to date")
    index.add_argument("--rebuild", action="store_true")
    index.add_argument("--project")
    index.add_argument("--pattern", "-p", action="append")
    index.add_argument("--workers", type=_positive)
    index.add_argument("--yes", "-y", action="store_true")

    status = commands.add_parser("status", help="counts of a project's index")
    status.add_argument("--project")

    project = commands.add_parser("project", help="manage projects").add_subparsers(dest="action", required=True)
    project.add_parser("create").add_argument("name")
    add = project.add_parser("add-path")
    add.add_argument("path", type=Path)
    add.add_argument("--project")
    project.add_parser("list")

    init = commands.add_parser("init", help="set up the configuration, or a project for this folder")
    init.add_argument("--global", dest="everywhere", action="store_true")
    init.add_argument("--yes", "-y", action="store_true")
    return top


def _confirmed(question: str, yes: bool) -> bool:
    return yes or input(f"{question} [y/N] ").strip().lower() in ("y", "yes")


def _settings(args) -> Config:
    try:
        return load_config(args.home)
    except ConfigError:
        if args.command == "search" and args.path is not None:
            return Config() if args.home is None else Config(home=args.home)
        raise


def _project(catalog: Catalog, config: Config, option: str | None):
    name = active_project(config, option, Path.cwd())
    found = catalog.get(name)
    if found is None:
        raise SiftwellError(f"there is no project {name!r}")
    return found


def _search(spark, config: Config, engine: Engine, args) -> str:
    options = {"k": args.top, "min_score": args.min_score, "paths": args.file_filter, "keyword": args.keyword}
    if args.path is not None:
        if not args.path.exists():
            raise SiftwellError(f"{args.path} does not exist")
        if not gather(args.path, args.pattern):
            return "[]" if args.output is OutputMode.JSON else "No matching files found."
        results = engine.search_path(args.path, args.query, args.pattern, **options)
        base = args.path.resolve() if args.path.is_dir() else args.path.resolve().parent
    else:
        project = _project(Catalog(spark, config), config, args.project)
        results = engine.search_project(engine.open(project.store_path), args.query, **options)
        base = Path.cwd()
    return render(results.persist(), args.output, str(base) if args.relative_paths else None)


def run(args) -> str:
    """Carry out a parsed command; what it prints."""
    spark = build_session()
    if args.command == "init":
        home = args.home or Config().home
        if args.everywhere:
            there = Config(home=home).file.exists()
            if there and not _confirmed("Overwrite the configuration?", args.yes):
                return "Nothing changed."
            init_global(spark, home, overwrite=True)
            return f"Configuration written to {Config(home=home).file}."
        project = init_local(Catalog(spark, _settings(args)), Path.cwd())
        return f"Project {project.name!r} covers {project.paths[0]}."

    config = _settings(args)
    engine = Engine(spark, chunker=WordChunker(config.chunk_size, config.chunk_overlap))
    if args.command == "search":
        return _search(spark, config, engine, args)

    catalog = Catalog(spark, config)
    if args.command == "project":
        if args.action == "create":
            return f"Project {catalog.create(args.name).name!r} created."
        if args.action == "list":
            return "\n".join(catalog.names()) or "No projects."
        name = active_project(config, args.project, Path.cwd())
        catalog.add_path(name, str(args.path))
        return f"{args.path.resolve()} added to {name!r}."

    project = _project(catalog, config, args.project)
    if args.command == "status":
        if not Store.there(spark, project.store_path):
            return f"Project {project.name!r} has no index."
        files, chunks = engine.open(project.store_path).counts()
        return f"Project {project.name!r}: {files} files, {chunks} chunks."

    if args.rebuild and not _confirmed(f"Rebuild the index of {project.name!r}?", args.yes):
        return "Nothing changed."
    if not project.paths:
        return f"Project {project.name!r} has no paths; add one with 'project add-path'."
    warnings: list[str] = []
    done = engine.index(engine.open(project.store_path, args.rebuild), project.paths, args.pattern, args.rebuild, args.workers, warnings.append)
    return "\n".join([*(f"Warning: {w}" for w in warnings), f"{done.processed} files processed, {done.chunks} chunks indexed, {done.errors} errors."])


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print(run(args))
    except (SiftwellError, ValueError, FileNotFoundError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
