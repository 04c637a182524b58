"""Written intermediate tables in the folder that driver and executors share.

A table that is read more than once, or that ends a long lineage, is written as
Parquet below ``spark.checkpoint.dir``: it survives lost executors, unlike a
local checkpoint. Where the session names no folder, a local master (tests, a
laptop) gets one of its own, and any other is refused: parts written to the disks
of single machines could be read back incompletely.

Tables stay as long as a frame may read them, which only the caller can know: an
``Owner`` notes the tables of a step and deletes them on request.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Where the tables of the current owner are noted, if there is one.
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; on a local master without one, a folder of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL.get(app) or _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quillon-"))
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that no live plan refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


class Owner:
    """Notes the tables written in its ``with`` blocks, and deletes those and no others."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    @contextmanager
    def __call__(self) -> Iterator[None]:
        token = _OWNED.set(self.paths)
        try:
            yield
        finally:
            _OWNED.reset(token)

    def purge(self, spark: SparkSession) -> None:
        """Delete what was noted so far. Call only once results that read it are stored."""
        while self.paths:
            delete(spark, self.paths.pop())
