"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. None of them changes results.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "footprints", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    shuffle = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one temporary folder a process, removed at its end, where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="footprints-"))
        atexit.register(shutil.rmtree, _local_folder[0], ignore_errors=True)
    return _local_folder[0]


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once per application."""
    context = spark.sparkContext
    if any(os.path.basename(p).startswith("footprints-code") for p in context.listFiles):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), "footprints-code")
    # Spark hands the archive to the executors itself; the folder is only read by the driver.
    context.addPyFile(shutil.make_archive(archive, "zip", root, "footprints"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so that losing an executor costs no recomputation from the start."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def not_collected(df: DataFrame) -> DataFrame:
    """The side of a join that grows with its table, joined by shuffles and never sent to the driver.

    Sizes are estimated from compressed files and default widths, so a genome or an annotation that is far larger would
    pass for a small table.
    """
    return df.hint("merge")
