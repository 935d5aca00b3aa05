"""Session settings and the folder through which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Settings a standalone run starts with; a cluster's own settings always win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", partitions)
    builder = builder.config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a temporary folder of its own; a cluster without it is
    an error, since its machines share no temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"marlstone-{spark.sparkContext.applicationId}")
    return folder.rstrip("/")


def written(df: DataFrame, label: str, counts: dict | None = None):
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors.

    With ``counts``, conditions by name, returns the table and how many rows meet each, counted as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    seen = Observation()
    rows = df.observe(seen, *[F.count(F.when(c, 1)).alias(k) for k, c in counts.items()]) if counts else df
    rows.write.mode("overwrite").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._marlstone_path = path  # noqa: SLF001
    return (back, seen.get) if counts else back


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for frame in frames:
        path = getattr(frame, "_marlstone_path", None)
        if path:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)  # noqa: SLF001
