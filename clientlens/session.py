"""Session construction and the shared work folder.

Jobs read the shared folder named by ``spark.checkpoint.dir``; a local
folder is only created when that setting is absent (tests, laptops)."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoints written by materialize() are removed once their DataFrame is gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | str = "*", app: str = "clientlens", **conf: str) -> SparkSession:
    """A local session with the settings the tests and bench use."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**_LOCAL_DEFAULTS, **conf}.items():
        b = b.config(k, v)
    b = b.config("spark.driver.memory", os.environ.get("CLIENTLENS_DRIVER_MEM", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once, unless they find it themselves (PYTHONPATH):
    stages that run in Python workers import it there."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED and _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        base = os.path.join(tempfile.mkdtemp(prefix="clientlens-code-"), "clientlens")
        with zipfile.ZipFile(f"{base}.zip", "w") as out:
            for d, _, files in os.walk(os.path.join(_ROOT, "clientlens")):
                for f in files:
                    if f.endswith((".py", ".yaml")):
                        out.write(os.path.join(d, f), os.path.relpath(os.path.join(d, f), _ROOT))
        spark.sparkContext.addPyFile(f"{base}.zip")
    _SHIPPED.add(app)


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, models and written tables.

    Uses ``spark.checkpoint.dir`` (a static setting read from the session) or a
    checkpoint folder already registered on the context; only when neither is
    set and the session is local (one machine) a fresh temporary folder is created and
    registered; on a cluster a missing setting is an error."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="clientlens-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def materialize(df):
    """Write a multi-consumer intermediate once to the shared checkpoint folder
    and cut its lineage, so the branches reading it do not each recompute it
    from the source tables (and a lost executor does not replay it)."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs run inside: for rows that are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet table at ``path`` with its declared schema; empty when there is none yet.
    Any other failure (permissions, storage) is an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
