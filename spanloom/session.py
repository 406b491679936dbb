"""Session construction and durable intermediate results."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "spanloom", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the queries expect (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where a session has none, a local master gets a temporary folder of its own; a cluster
    without the setting is an error, as a machine-local folder would lose data there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="spanloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_owned: dict[str, object] = {}


def _own_dir(spark: SparkSession) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/spanloom-{spark.sparkContext.applicationId}"
    if path not in _owned:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        _owned[path] = lambda: system.delete(hadoop, True)
        atexit.register(_remove, path)
    return path


def _remove(path: str) -> None:
    remove = _owned.pop(path, None)
    if remove is not None:
        with contextlib.suppress(Exception):  # the JVM may have ended before
            remove()


def release(spark: SparkSession) -> None:
    """Remove what ``materialize`` wrote for this application. Results that were not computed by then can't be any more."""
    _remove(f"{shared_dir(spark).rstrip('/')}/spanloom-{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors.

    For results that several jobs read (corpus statistics, per-row sizes); each is written as Parquet
    under a fresh name in the application's own folder, so reruns never see one another's files. The
    application owns that folder and removes it when its driver ends; ``release`` does so at once.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per session, unless they find it by themselves through PYTHONPATH or the working folder."""
    root = Path(__file__).resolve().parents[1]
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if spark.conf.get("spanloom.shipped", None) or any(p and Path(p).resolve() == root for p in paths):
        return
    at = tempfile.mkdtemp(prefix="spanloom-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{at}/spanloom", "zip", root, "spanloom"))  # Spark copies it to every executor
    spark.conf.set("spanloom.shipped", "true")
