"""Event tables that streams append to, each batch once.

A micro-batch is written to a folder named by its query and number, and then entered in a
ledger, a file made exclusively. Readers take only what the ledger names. A batch that is run
again, since its query died between the two or before its checkpoint, overwrites its folder if
it isn't entered yet and does nothing else. Several queries may write to one table.

Rows with keys are upserted by reading: the newest row of a key counts. ``compact`` writes the
newest rows as one folder and enters what it stands for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.shadow import Pointer


class EventTable:
    """A table of ``schema`` below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._files = Pointer(spark, f"{self.path}/ledger")

    def entered(self) -> dict[str, dict]:
        """The ledger: batches in force, without those that a compaction stands for."""
        found = {n: json.loads(self._files._text(f"{self.path}/ledger/{n}")) for n in self._files._names(f"{self.path}/ledger")}
        gone = {b for v in found.values() for b in v["replaces"]}
        return {n: v for n, v in found.items() if n not in gone}

    def _write(self, rows: DataFrame, name: str, replaces: Sequence[str] = ()) -> bool:
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={name}")
        return self._files._create(f"{self.path}/ledger/{name}", json.dumps({"replaces": sorted(replaces)}))

    def write(self, batch: DataFrame, query: str, number: int) -> bool:
        """Whether the batch was new."""
        name = f"{query}-{number:012d}"
        if name in self._files._names(f"{self.path}/ledger"):
            return False
        return self._write(batch.select(*[c for c in self.spark.createDataFrame([], self.schema).columns]), name)

    def rows(self) -> DataFrame:
        names = list(self.entered())
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(f"{self.schema}, batch string").parquet(f"{self.path}/rows").filter(F.col("batch").isin(names)).drop("batch")

    def latest(self, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
        """The newest row of each key by ``order``, by partial maxima."""
        rows = self.rows()
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))
        return newest.select("row.*")

    def compact(self, keys: Sequence[str], order: Sequence[Column]) -> None:
        replaced = list(self.entered())
        self._write(self.latest(keys, order), f"compact-{uuid.uuid4().hex}", replaced)


def start(stream: DataFrame, table: EventTable, query: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Starts a query that writes what ``shape`` makes of each micro-batch, until all that is there is read."""
    return (
        stream.writeStream.foreachBatch(lambda batch, number: table.write(shape(batch), query, number) and None)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
