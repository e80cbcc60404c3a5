"""Session settings the operators count on, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "leafmill", memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where that setting is absent, a folder of this application in the warehouse, which executors
    share as well; a local session takes it away when it ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        folder = f"{warehouse}/shared-{spark.sparkContext.applicationId}"
        if spark.sparkContext.master.startswith("local["):
            atexit.register(shutil.rmtree, folder.removeprefix("file:"), ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that a lost executor cannot change it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
