"""Tables that a job writes between its steps, in the folder that all executors share."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from ..session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a step's rows as Parquet and reads them again.

    Later steps start from files, so a lost executor repeats no earlier step, and values that
    depend on the order of rows stay as they were written.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark removes the shuffle files of an SQL execution when it ends, instead of when the driver's garbage is collected.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one job's inner steps, under one folder that goes when the job has its result.

    With ``free_shuffles``, a step's shuffle files go as soon as its table is written.
    """

    def __init__(self, df: DataFrame, name: str, free_shuffles: bool = False):
        self.spark, self.root, self.count = df.sparkSession, scratch_path(df.sparkSession, name), 0
        self.free_shuffles = free_shuffles

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        before = self.spark.conf.get(FREE_SHUFFLES, None)
        if self.free_shuffles:
            self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.free_shuffles:
                self.spark.conf.unset(FREE_SHUFFLES) if before is None else self.spark.conf.set(FREE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: DataFrame) -> None:
        """Removes a table that no later step reads."""
        for file in {os.path.dirname(file) for file in table.inputFiles()}:
            self._delete(file)

    def clear(self) -> None:
        """Removes the folder, by the file system that holds it."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out
