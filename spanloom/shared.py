"""Tables in the folder that driver and executors share, which cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one on local masters (tests); on others, whose executors
    would not see it, RuntimeError."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder.

    A table lives until drop() or, as results are lazy and may read it late, the end of the process. Between tables Spark may
    drop old shuffle files; thorough: it is waited for, for operators that need the disk; light: nothing is done for it, for
    plans of many small tables.
    """

    def __init__(self, spark: SparkSession, name: str, thorough: bool = False, light: bool = False):
        self.spark, self.rounds = spark, 3 if thorough else 0 if light else 1
        self.root = f"{shared_dir(spark)}/spanloom-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        self._release()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _release(self) -> None:
        """Lets Spark's cleaner drop shuffle files that no plan refers to any more; it acts on the driver's collection of garbage."""
        for _ in range(self.rounds):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.25 * (self.rounds - 1))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))
        self._release()

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.root)
        elif self.root.startswith("file:"):  # the session has ended before
            shutil.rmtree(self.root.removeprefix("file:").replace("///", "/"), ignore_errors=True)
