"""Session construction and the few cluster-wide settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "siftwell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    share_code(spark)
    return spark


def share_code(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package.

    On a cluster the package is shipped with ``--py-files``; in local mode the workers run on
    this host, so the path of the checkout is enough.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


#: Rows that go to a Python worker at once; what a worker holds follows from it, not from the size of the table.
ARROW_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Batches of ARROW_ROWS rows for operators whose rows hold texts or vectors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, as in tests, gets a
    folder of its own when nothing is set; elsewhere a missing setting is an error, because a
    machine-local folder would not be seen by other executors.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir()
    if named:
        return named
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="siftwell-checkpoint-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()
