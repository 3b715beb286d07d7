"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: SQL settings the jobs count on; all of them can be changed on a live session.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join is split even when the result needs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # HotSpot never compiles methods above 8000 bytes; wide rule selects
    # then use the split, compiled projection instead of one interpreted loop
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

#: Setting with the number of tasks that logs and texts are dealt out to when read; unset, they stay as split.
INPUT_PARTITIONS = "spark.emberwatch.inputPartitions"

#: Settings that only a new session takes.
STATIC_SETTINGS = {
    # rules make thousands of Columns; recording a call site for each is slow
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above to an existing session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Tasks import it by name, wherever the driver was started. The archive is the driver's own;
    executors fetch it from the driver's file server.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp()) / f"{package.name}-code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    A cluster names it in ``spark.checkpoint.dir``; without the name a job there
    ends, as no folder of one machine will do. Only a local session, which has
    one machine, gets a fresh folder of its own, remembered on the context.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="emberwatch-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder, so later steps do not depend on executors."""
    work_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: worked out once, and later plans start from it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
