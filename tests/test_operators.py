import time

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import chunking, memory, rules
from corpusloom.sources import files
from corpusloom.streaming import logs


def test_pack_is_greedy(spark):
    df = spark.createDataFrame([(["aa", "bb", "cccccccc", "d"],)], "x array<string>")
    assert df.select(chunking.pack(F.col("x"), 5)).first()[0] == ["aa\nbb", "cccccccc", "d"]


def test_pack_of_nothing(spark):
    assert spark.createDataFrame([([],)], "x array<string>").select(chunking.pack(F.col("x"), 5)).first()[0] == []


def test_recursive_chunks_keep_to_the_size(spark):
    text = "one two three. four five six\n\nseven eight nine ten eleven twelve " * 20
    out = chunking.recursive_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), 60, 10).collect()
    assert out and all(len(r["text"]) <= 60 for r in out)
    assert set(" ".join(r["text"] for r in out).replace(".", "").split()) == set(text.replace(".", "").split())


def test_dictionary_boundaries_and_negators(spark):
    df = spark.createDataFrame([(1, "pain, no pain; painful chest pain"), (2, None), (3, "头疼不头疼")], "id long, text string")
    hits = rules.find_all(df, {"pain": "p", "chest pain": "cp", "头疼": "h"}, negators=["no ", "不"]).orderBy("id", "start").collect()
    assert [(r["id"], r["keyword"], r["start"]) for r in hits] == [(1, "pain", 0), (1, "chest pain", 23), (3, "头疼", 0)]


def test_head_and_tail(spark):
    df = spark.createDataFrame([("abcdefghij",), ("abc",)], "s string")
    assert [r[0] for r in df.select(t.head_and_tail(F.col("s"), 6)).collect()] == ["abcdij", "abc"]


def test_replacement_is_in_turn(spark):
    df = spark.createDataFrame([("ab",)], "s string")
    assert df.select(t.replace_in_turn(F.col("s"), [("a", "b"), ("bb", "c")])).first()[0] == "c"


def test_retention_and_replay(spark):
    out = spark.createDataFrame([(1, 7, 0), (2, 7, 0), (3, 8, 9), (4, 9, 0)], "id long, event_id long, retries int")
    sent, left = memory.replay(out, spark.createDataFrame([(9,)], "event_id long"), F.col("event_id") == 8)
    assert [r["id"] for r in sent.collect()] == [1] and left.count() == 0


def test_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("病人".encode("gbk"))
    (tmp_path / "b.md").write_bytes("# é".encode())
    rows = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.read_texts(spark, f"file://{tmp_path}").collect()}
    assert rows == {"a.txt": "病人", "b.md": "# é"}


def test_html_tables():
    page = "<table><tr><th>a</th><th>b</th></tr><tr><td>1 &amp; 2</td></tr></table>"
    assert files.tables_in(page) == ["| a | b |\n| --- | --- |\n| 1 & 2 |  |"]


def test_pointer(spark, tmp_path):
    at = f"file://{tmp_path}/pointer"
    files.write_pointer(spark, at, "a", None)
    files.switch(spark, at, "b")
    assert files.read_pointer(spark, at) == ("b", "a")
    files.roll_back(spark, at)
    assert files.read_pointer(spark, at) == ("a", "b")


def _stream(spark, tmp_path, frame, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).toPandas()


def _events(n=40):
    base = pd.Timestamp("2024-01-01")
    return pd.DataFrame({"event_id": range(n), "ts": [base + pd.Timedelta(seconds=7 * k) for k in range(n)], "user_id": [k % 2 for k in range(n)], "event_type": "a", "value": 1.0, "props": "{}"})


def test_stream_limit_equals_batch(spark, tmp_path):
    spark.createDataFrame(_events(), logs.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    live = _stream(spark, tmp_path, logs.limited(logs.read_events(spark, f"{tmp_path}/in"), 2, 60), f"limit{int(time.time())}")
    batch = logs.limited_batch(spark.read.parquet(f"{tmp_path}/in"), 2, 60).toPandas()
    assert sorted(map(tuple, live.values)) == sorted(map(tuple, batch.values))
    assert 0 < batch["accepted"].sum() < len(batch)


def test_stream_snapshots(spark, tmp_path):
    spark.createDataFrame(_events(), logs.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = _stream(spark, tmp_path, logs.snapshots(logs.read_events(spark, f"{tmp_path}/in"), 8), f"snap{int(time.time())}")
    assert sorted(out["n"]) == [9, 9, 9, 9]


def test_delivery_is_once(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame(_events(), logs.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        logs.deliver(logs.read_events(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40


def test_hashed_vectors(spark):
    import hashlib

    from corpusloom.functions.vectors import hashed_vectors

    texts = [(1, ["a", "b", "a"]), (2, []), (3, None), (4, [f"w{n}" for n in range(300)]), (1, ["c"])]
    got = {r["id"]: list(r["v"]) for r in hashed_vectors(spark.createDataFrame(texts, "id long, terms array<string>"), "id", F.col("terms"), 16).collect()}
    want = {}
    for i, terms in texts:
        for t_ in terms or []:
            digest = hashlib.md5(t_.encode()).hexdigest()
            want.setdefault(i, [0.0] * 16)[int(digest[:2], 16) % 16] += 1.0 if digest[2] < "8" else -1.0
    assert got == want


def test_hashed_vectors_move_rows_not_words(spark):
    from corpusloom.functions.vectors import hashed_vectors
    from tests.test_sparse_index import records_moved

    texts = spark.createDataFrame([(n, [f"w{k}" for k in range(500)]) for n in range(40)], "id long, terms array<string>")
    before = records_moved(spark)
    assert hashed_vectors(texts, "id", F.col("terms")).count() == 40
    assert hashed_vectors(texts, "id", F.col("terms")).filter("size(v) = 64").count() == 40
    assert records_moved(spark) - before <= 200
