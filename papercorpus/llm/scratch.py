"""Tables kept for the length of one operator in the shared folder of the session."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import scratch_path, ship_package


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go as soon as it ends, not when the driver next collects garbage."""
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


class Scratch:
    """Stores tables as Parquet in the shared folder and deletes those no longer read.

    A stored table survives lost executors and has a measured size. The ones that a
    returned DataFrame still reads stay, as checkpoint files do. Nothing reads the
    shuffles behind a stored table again, so they are freed with its write.
    """

    def __init__(self, spark: SparkSession):
        ship_package(spark)
        self.spark = spark
        self.paths: dict[int, str] = {}

    def store(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        with shuffles_freed(self.spark):
            df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = self.paths.pop(id(table), None)
            if path:
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def spare(name: str, df: DataFrame) -> str:
    """``name``, or a longer one that is no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
