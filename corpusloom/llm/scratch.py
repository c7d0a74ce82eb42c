"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs no more than the stage it was working on.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LIVE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def free_names(df: DataFrame, count: int) -> list[str]:
    """Column names that ``df`` doesn't have, in any case of letters."""
    taken, found, k = {c.lower() for c in df.columns}, [], 0
    while len(found) < count:
        if (name := f"inner_{k}") not in taken:
            found.append(name)
        k += 1
    return found


class Scratch:
    """A folder of tables for one run of an operator.

    ``table`` writes a frame and returns it reread; ``drop`` deletes one that no later
    step reads. What is left goes with ``close`` or at the end of the interpreter, since
    results are lazy and may still read it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._count = 0
        _LIVE[self.root] = spark

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._count}"
        self._count += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            _delete(self.spark, f._scratch_path)

    def close(self) -> None:
        _delete(self.spark, self.root)
        _LIVE.pop(self.root, None)


@atexit.register
def _close_all() -> None:
    for root, spark in list(_LIVE.items()):
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001  the JVM may be gone by now
            pass
