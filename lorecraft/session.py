"""Spark sessions and the few settings the library depends on."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def session(name: str = "lorecraft", cores: str = "*", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; ``conf`` overrides (dots as ``__``)."""
    builder = SparkSession.builder.appName(name).master(f"local[{cores}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


#: Bytes of an Arrow batch sent to a Python worker: texts may be long, workers are many.
BATCH_BYTES = "8m"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that lack it, and bound their batches."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if getattr(sc, "_lorecraft_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="lorecraft-")) / "lorecraft-src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(target))
    sc._lorecraft_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: what the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent is a folder of our own set, in local runs and tests;
    a cluster must name one that all executors share.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "lorecraft-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


class Settled:
    """Rows as a table of files in the checkpoint folder: ``rows`` reads them.

    A checkpoint keeps the size that was estimated for its plan, and for joins that is the product of their sides. In a loop that joins its
    own checkpoints this number gets twice as many digits or more each round, until the driver does little but multiply it. A table that is read back has the
    size of its files.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.folder = f"{ensure_checkpoint_dir(self.spark)}/settled-{uuid4().hex}"
        df.write.parquet(self.folder)
        self.rows = self.spark.read.schema(df.schema).parquet(self.folder)

    def discard(self) -> None:
        """Deletes the files, once nothing reads them any more."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets the context drop shuffle files and checkpoints that no table refers to any more.

    Spark does so when the driver collects garbage, which in a long chain of small jobs
    may come after the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
