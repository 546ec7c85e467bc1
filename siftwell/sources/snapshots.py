"""Project tables as immutable snapshots with a pointer to the current one.

A run writes its tables into a new folder and then a new pointer file, numbered one higher; readers take
the newest and so see the old state or the new one, never a mixture. All paths go through Spark's file
systems.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.errors import ConfigError, MetadataError

MAX_LABEL = "max_label"
#: Beginning of the names of pointer files; a number follows.
POINTER = "CURRENT-"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, at = _fs(spark, new)
    fs.mkdirs(at.getParent())
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(old), at):
        raise OSError(f"{old} cannot be moved to {new}")


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def new_folder(df: DataFrame, path: str) -> None:
    """``df`` as Parquet at ``path``, where nothing is yet: written beside it, then moved there whole."""
    spark, staged = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        df.write.parquet(staged)
        _rename(spark, staged, path)
    except Exception:
        delete(spark, staged)
        raise


def _pointers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the pointer files in ``folder``, the newest first."""
    fs, at = _fs(spark, folder)
    if not fs.exists(at):
        return []
    names = [str(f.getPath().getName()) for f in fs.listStatus(at)]
    return sorted((int(n[len(POINTER) :]) for n in names if n.startswith(POINTER) and n[len(POINTER) :].isdigit()), reverse=True)


def read_pointer(spark: SparkSession, folder: str) -> dict | None:
    """What the newest readable pointer file in ``folder`` says; None if there is none."""
    for number in _pointers(spark, folder):
        try:
            return json.loads(read_text(spark, f"{folder}/{POINTER}{number:08d}"))
        except ValueError:
            continue
    return None


def write_pointer(spark: SparkSession, folder: str, value: dict) -> None:
    """A new pointer file, moved into place whole under the next number; older ones but the last go.

    At every moment the newest pointer that is there is valid. Of two writers that take the same number
    one fails.
    """
    known = _pointers(spark, folder)
    staged = f"{folder}/.{uuid.uuid4().hex}"
    fs, at = _fs(spark, staged)
    fs.mkdirs(at.getParent())
    out = fs.create(at)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    final = f"{folder}/{POINTER}{(known[0] if known else 0) + 1:08d}"
    if exists(spark, final) or not fs.rename(at, _fs(spark, final)[1]):
        fs.delete(at, False)
        raise OSError(f"{final} cannot be written")
    for number in known[1:]:
        delete(spark, f"{folder}/{POINTER}{number:08d}")


def save_table(df: DataFrame, folder: str) -> None:
    """``df`` as the current table of ``folder``; the one before stays until the next, for readers that are under way."""
    spark = df.sparkSession
    before = read_pointer(spark, folder)
    name = f"data-{uuid.uuid4().hex}"
    try:
        df.write.parquet(f"{folder}/{name}")
        write_pointer(spark, folder, {"data": name, "before": before and before["data"]})
    except Exception:
        delete(spark, f"{folder}/{name}")
        raise
    if before and before.get("before"):
        delete(spark, f"{folder}/{before['before']}")


def load_table(spark: SparkSession, folder: str) -> DataFrame:
    found = read_pointer(spark, folder)
    if found is None:
        raise FileNotFoundError(folder)
    return spark.read.parquet(f"{folder}/{found['data']}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Store:
    """Files, chunks with vectors, and key-values of one project."""

    TABLES = {"files": schemas.FILES, "chunks": schemas.CHUNKS, "key_values": schemas.KEY_VALUES}

    def __init__(self, spark: SparkSession, path: str, settings: dict | None = None, rebuild: bool = False):
        """Opens the store at ``path``, made empty if there is none.

        ``settings`` must agree with those it was made with, unless a ``rebuild`` is to follow, whose
        commit records them.
        """
        self.spark, self.path = spark, path.rstrip("/")
        pointer = read_pointer(spark, self.path)
        if pointer is None:
            self._settings = settings or {}
            self.commit(**{t: spark.createDataFrame([], s) for t, s in self.TABLES.items()})
            return
        self._settings = pointer["settings"]
        for key, value in (settings or {}).items():
            if not rebuild and self._settings.get(key, value) != value:
                raise ConfigError(f"the project was indexed with {key} = {self._settings[key]}, not {value}; rebuild it to change that")
        self._settings = self._settings | (settings or {})

    @staticmethod
    def there(spark: SparkSession, path: str) -> bool:
        return read_pointer(spark, path.rstrip("/")) is not None

    def _pointer(self) -> dict:
        return read_pointer(self.spark, self.path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.TABLES[name]).parquet(f"{self.path}/{self._pointer()['snapshot']}/{name}")

    @property
    def files(self) -> DataFrame:
        return self.table("files")

    @property
    def chunks(self) -> DataFrame:
        return self.table("chunks")

    @property
    def key_values(self) -> DataFrame:
        return self.table("key_values")

    def commit(self, **tables: DataFrame) -> None:
        """A new snapshot of all three tables; those not given stay as they are.

        The snapshot before stays until the next commit, for readers that are under way.
        """
        old = self._pointer()
        new = f"snapshot-{uuid.uuid4().hex}"
        try:
            for name, schema in self.TABLES.items():
                df = tables.get(name)
                df = self.table(name) if df is None else df
                df.select([F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(f"{self.path}/{new}/{name}")
            write_pointer(self.spark, self.path, {"snapshot": new, "before": old and old["snapshot"], "settings": self._settings})
        except Exception:
            delete(self.spark, f"{self.path}/{new}")
            raise
        if old and old.get("before"):
            delete(self.spark, f"{self.path}/{old['before']}")

    def counts(self) -> tuple[int, int]:
        row = index_counts(self.files, self.chunks).first()
        return row["files"], row["chunks"]

    def value(self, key: str) -> str | None:
        row = self.key_values.where(F.col("key") == key).first()
        return row["value"] if row else None

    def max_label(self) -> int | None:
        """The stored label counter; None if there is none or it is no number."""
        found = self.value(MAX_LABEL)
        try:
            return None if found is None else int(found)
        except ValueError:
            return None


def index_counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``files, chunks``: both row counts in one row."""
    return files.agg(F.count(F.lit(1)).alias("files")).crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))


def upserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``key, value`` with new values in place of stored ones."""
    return stored.join(new, "key", "left_anti").select("key", "value").unionByName(new.select("key", "value"))


def first_of_each(rows: DataFrame, path_col: str, order_col: str, stored: DataFrame | None = None, id_col: str = "file_id") -> DataFrame:
    """``rows`` to insert: the first of each path, without ids that ``stored`` or an earlier row has."""
    from pyspark.sql import Window

    for col in (path_col, id_col):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(col).orderBy(order_col))).where("_n = 1").drop("_n")
    return rows if stored is None else rows.join(stored.select(id_col), id_col, "left_anti")


def require_unique(df: DataFrame, column: str) -> DataFrame:
    if df.groupBy(column).count().where("count > 1").limit(1).count():
        raise MetadataError(f"{column} is not unique")
    return df
