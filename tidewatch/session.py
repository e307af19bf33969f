"""Session settings and the reliable-checkpoint helper."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", app: str = "tidewatch") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> None:
    """Timestamps are handled as UTC wall clock everywhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches (``spark.checkpoint.dir``).

    Only an unset, local session falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="tidewatch-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably; iterative operators call this once per round."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def deal_out(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key over all shuffle partitions.

    Left to itself, adaptive execution merges partitions by their packed size, and what a task orders or groups in memory is many times that.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, if they would not find it by their path or working folder."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    java = sc._jvm.System
    known = [*(java.getenv("PYTHONPATH") or "").split(":"), java.getProperty("user.dir")]
    if str(root) in known or getattr(sc, "_tidewatch_shipped", False):
        return
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="tidewatch-code-")) / "tidewatch"), "zip", root, "tidewatch")
    sc.addPyFile(archive)
    sc._tidewatch_shipped = True
