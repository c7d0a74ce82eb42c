"""Streams into event tables: killed, started again, delivered twice, compacted."""

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming.writers import EventTable, start

SCHEMA = "id long, key string, v double"


def feed(spark, path, ids):
    spark.createDataFrame([(k, f"k{k % 3}", float(k)) for k in ids], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def ids(table):
    return sorted(r["id"] for r in table.rows().collect())


@pytest.mark.parametrize("where", ["before the rows", "before the ledger", "after the ledger"])
def test_killed_and_restarted(spark, tmp_path, monkeypatch, where):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for a in range(0, 40, 10):
        feed(spark, source, range(a, a + 10))
    table = EventTable(spark, f"file://{tmp_path}/table", SCHEMA)
    plain_write, plain_entry, calls = EventTable._write, table._files._create, []

    def die():
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")

    def dying_write(self, rows, name, replaces=()):
        if where == "before the rows":
            die()
        out = plain_write(self, rows, name, replaces)
        if where == "after the ledger":
            die()
        return out

    def dying_entry(*a):
        if where == "before the ledger":
            die()
        return plain_entry(*a)

    monkeypatch.setattr(EventTable, "_write", dying_write)
    monkeypatch.setattr(table._files, "_create", dying_entry)
    with pytest.raises(Exception):  # noqa: B017  the stream's own exception
        start(stream(spark, source), table, "q", log).awaitTermination()
    assert set(ids(table)) <= set(range(40)) and len(ids(table)) in (10, 20)
    start(stream(spark, source), table, "q", log).awaitTermination()
    assert ids(table) == list(range(40))
    feed(spark, source, range(40, 45))
    start(stream(spark, source), table, "q", log).awaitTermination()
    assert ids(table) == list(range(45))


def test_two_writers_upserts_and_compaction(spark, tmp_path):
    table = EventTable(spark, f"file://{tmp_path}/table", SCHEMA)
    assert table.rows().collect() == [] and table.latest(["key"], [F.col("id")]).collect() == []
    batch = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert table.write(batch((1, "a", 1.0), (2, "b", 2.0)), "q", 0) and table.write(batch((3, "a", None)), "p", 0)
    assert not table.write(batch((1, "a", 1.0)), "q", 0) and ids(table) == [1, 2, 3]
    newest = lambda: sorted(tuple(r) for r in table.latest(["key"], [F.col("id")]).collect())
    assert newest() == [(2, "b", 2.0), (3, "a", None)]
    table.compact(["key"], [F.col("id")])
    assert ids(table) == [2, 3] and len(table.entered()) == 1 and not table.write(batch((1, "a", 1.0)), "q", 0)
    table.write(batch((9, "b", 0.5)), "q", 1)
    assert newest() == [(3, "a", None), (9, "b", 0.5)]
