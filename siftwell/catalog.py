"""Projects and the folders they index."""

from __future__ import annotations

from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.config import MARKER, Config, find_root, project_of, save_config, write_toml
from siftwell.errors import ConfigError, MetadataError
from siftwell.sources.snapshots import exists, new_folder


class Project(NamedTuple):
    name: str
    paths: list[str]
    store_path: str
    embedding_model_name: str


def with_paths(projects: DataFrame, paths: DataFrame) -> DataFrame:
    """Projects with their paths as an array; a project without paths has an empty one."""
    per = paths.groupBy("project_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return projects.join(per, "project_id", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>"))).orderBy("project_name")


def new_paths(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted (project_id, path)`` that ``stored`` lacks, once each."""
    return wanted.select("project_id", "path").distinct().join(stored, ["project_id", "path"], "left_anti")


def numbered_projects(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ids behind the largest stored one; names that are taken give no row."""
    fresh = wanted.join(stored.select("project_name"), "project_name", "left_anti")
    top = stored.agg(F.coalesce(F.max("project_id"), F.lit(0)).alias("top"))
    return fresh.withColumn("n", F.row_number().over(Window.orderBy("project_name"))).crossJoin(F.broadcast(top)).withColumn("project_id", (F.col("top") + F.col("n")).cast("long")).drop("top", "n")


class Catalog:
    """The project tables of one home folder."""

    TABLES = {"projects": schemas.PROJECTS, "project_paths": schemas.PROJECT_PATHS}

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        for name, schema in self.TABLES.items():
            if not exists(spark, self._at(name)):
                new_folder(spark.createDataFrame([], schema), self._at(name))

    def _at(self, name: str) -> str:
        return f"{self.config.catalog}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.TABLES[name]).parquet(self._at(name))

    def _append(self, name: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.TABLES[name]).coalesce(1).write.mode("append").parquet(self._at(name))

    def create(self, name: str, paths: list[str] | None = None) -> Project:
        if self.table("projects").where(F.col("project_name") == name).limit(1).count():
            raise MetadataError(f"project {name!r} exists already")
        number = (self.table("projects").agg(F.max("project_id")).first()[0] or 0) + 1
        self._append("projects", [(number, name, f"{self.config.home}/projects/{name}", self.config.embedding_model_name)])
        for path in paths or []:
            self.add_path(name, path)
        return self.get(name)

    def add_path(self, name: str, path: str) -> None:
        """Adding a path twice changes nothing."""
        row = self.table("projects").where(F.col("project_name") == name).first()
        if row is None:
            raise MetadataError(f"there is no project {name!r}")
        path = str(Path(path).resolve())
        wanted = self.spark.createDataFrame([(row["project_id"], path)], schemas.PROJECT_PATHS)
        if new_paths(self.table("project_paths"), wanted).count():
            self._append("project_paths", [(row["project_id"], path)])

    def get(self, name: str) -> Project | None:
        row = with_paths(self.table("projects").where(F.col("project_name") == name), self.table("project_paths")).first()
        return None if row is None else Project(row["project_name"], row["paths"], row["store_path"], row["embedding_model_name"])

    def names(self) -> list[str]:
        return [r["project_name"] for r in self.table("projects").select("project_name").orderBy("project_name").collect()]


def init_global(spark: SparkSession, home: Path, overwrite: bool = False) -> Config:
    """Configuration and catalog of ``home`` with a default project; an existing default project is kept."""
    config = Config(home=Path(home))
    if config.file.exists() and not overwrite:
        raise ConfigError(f"{config.file} exists already")
    save_config(config)
    catalog = Catalog(spark, config)
    if catalog.get(config.default_project) is None:
        catalog.create(config.default_project)
    return config


def init_local(catalog: Catalog, folder: Path) -> Project:
    """A project for ``folder``, named after it, with a marker file there."""
    folder = Path(folder).resolve()
    if (folder / MARKER).exists():
        raise ConfigError(f"{folder} is a project already")
    project = catalog.create(folder.name.lower().replace(" ", "-"), [str(folder)])
    write_toml(folder / MARKER, {"project_name": project.name})
    return project


def active_project(config: Config, option: str | None, start: Path) -> str:
    """The named project, else that of the nearest marked folder, else the default one."""
    if option:
        return option
    root = find_root(start)
    return (project_of(root) if root else None) or config.default_project
