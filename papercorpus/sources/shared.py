"""The shared folder of the session, and tables stored in it to cut lineage."""

from __future__ import annotations

import tempfile
from pathlib import Path
from uuid import uuid4
from zipfile import ZipFile

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once per application.

    Not needed where the package is installed on every machine or given with
    ``--py-files``; without either, workers could not load the Python helpers.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="papercorpus-")) / "papercorpus-package.zip"
    with ZipFile(archive, "w") as files:
        for source in sorted(PACKAGE.rglob("*.py")):
            files.write(source, source.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the session's settings.

    Only on a single machine (master ``local``), where none is named, a fresh temporary
    folder is made and becomes the session's checkpoint folder. On a cluster that would
    be a folder of each machine's own, so it is an error there.
    """
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set {SETTING} to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="papercorpus-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/papercorpus/{label}-{uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and return the written table.

    The table survives lost executors, prunes columns on every later read, and
    has a measured size, so Spark broadcasts it in a join only while it is below
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(table: DataFrame, per_core: int = 1) -> DataFrame:
    """Deal a table out to ``per_core`` tasks for each core; tables with as many pieces stay as they are.

    A single file with a single row group is one task however much work follows, and a few
    more pieces than cores leave most cores idle for the last ones.
    For tables as they are read: counting the pieces of a scan runs no job.
    """
    tasks = per_core * table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(tasks) if table.rdd.getNumPartitions() < tasks else table
