"""Session and lineage helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def get_session(app: str = "vintaloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time and adaptive execution; cluster settings come from spark-submit."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the cluster's shared one (spark.checkpoint.dir), removed when Python ends.

    Where none is set, a local master gets a temporary folder; on a cluster that is an error, since every
    executor would write to its own disk.
    """
    sc = spark.sparkContext
    known = getattr(sc, "_vintaloom_folder", None)
    if known:
        return known
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    sc._vintaloom_folder = f"{base.rstrip('/')}/vintaloom-{sc.applicationId}-{os.getpid()}"
    atexit.register(release, spark)
    return sc._vintaloom_folder


def release(spark: SparkSession) -> None:
    """Remove all that cut() has written; frames that still read it can't be used any more."""
    sc = spark.sparkContext
    folder = getattr(sc, "_vintaloom_folder", None)
    if not folder or sc._jsc is None:
        return
    try:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass
    sc._vintaloom_folder = None


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: its lineage ends there, and it survives the loss of executors.

    Columnar, so each reader takes only the columns it needs (a checkpoint would deserialise whole rows).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for a broadcast if it has at most `rows` rows, otherwise left to the optimizer; counts df."""
    return broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python workers find it wherever they start."""
    sc = spark.sparkContext
    if getattr(sc, "_vintaloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="vintaloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors may fetch it at any time until then
    target = Path(folder) / "vintaloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._vintaloom_shipped = True
