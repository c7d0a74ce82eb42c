"""Folders that driver and executors share, and tables kept in them while a session lasts."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_HELD: dict[tuple[str, str], tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder, deleted at the end of the interpreter."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _HELD[(path, "")] = (spark, path)
    return path


def kept(rows: DataFrame, label: str) -> DataFrame:
    """Rows written once to a new folder and reread, for few rows that several steps read or that meet a large table."""
    path = fresh_dir(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def file_state(table: DataFrame) -> str:
    """A digest of the files a table is read from: names, sizes and times."""
    m = "_metadata"
    rows = table.select(f"{m}.file_path", f"{m}.file_size", f"{m}.file_modification_time").distinct().collect()  # a row a file
    return hashlib.sha256(repr(sorted(map(tuple, rows))).encode()).hexdigest()


def held(table: DataFrame, label: str, make: Callable[[str], None]) -> str:
    """The folder that ``make`` filled from ``table``; made once for the same files in a session."""
    spark = table.sparkSession
    key = (f"{spark.sparkContext.applicationId}/{label}", file_state(table))
    if key not in _HELD:
        path = fresh_dir(spark, label)
        make(path)
        _HELD[key] = (spark, path)
    return _HELD[key][1]


@atexit.register
def _delete_all() -> None:
    for spark, path in list(_HELD.values()):
        try:
            sc = spark.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may be gone by now
            pass
