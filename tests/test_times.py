"""Numerals and time expressions against a reading by hand."""

import datetime

from pyspark.sql import functions as F

from corpusloom.operators import times

NOW = datetime.datetime(2024, 3, 5, 10, 30, 15)


def spoken(n):
    """A number below ten thousand in Chinese numerals."""
    out, zero = "", False
    for unit, name in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        d = n // unit % 10
        if d:
            out += ("零" if zero and out else "") + ("" if unit == 10 and d == 1 and not out else times.DIGITS[d - 1]) + name
            zero = False
        else:
            zero = True
    return out or "零"


def test_numbers(spark):
    numbers = [0, 1, 2, 9, 10, 11, 19, 20, 21, 99, 100, 101, 110, 115, 203, 250, 999, 1000, 1001, 1010, 1203, 4321, 9999]
    rows = [(spoken(n), float(n)) for n in numbers] + [(str(n), float(n)) for n in numbers] + [("半", 0.5), ("两", 2.0), ("两百", 200.0), ("一百〇三", 103.0)]
    got = spark.createDataFrame(rows, "t string, n double").select("t", "n", times.number(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in got] == [r["n"] for r in got]


def test_expressions(spark):
    ago = lambda **k: NOW - datetime.timedelta(**k)
    cases = [
        ("持续三天", ago(days=3), "day"), ("疼了，有12 小时", ago(hours=12), "hour"), ("头痛两周了", ago(weeks=2), "week"), ("十二个月前", ago(days=360), "month"),
        ("半年了", ago(seconds=15768000), "year"), ("已经四十分钟", ago(minutes=40), "minute"), ("二十五天以来", ago(days=25), "day"),
        ("昨天开始", ago(days=1), "day"), ("大前天发热", ago(days=3), "day"), ("上周", ago(days=7), "week"), ("去年", ago(days=365), "year"),
        ("上周持续两天了", ago(days=2), "day"), ("三天了，昨天加重", ago(days=3), "day"), ("3天", None, "default"), ("几天了", None, "vague"), ("没有时间", None, "default"), (None, None, "default"), ("", None, "default"),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(cases)], "k int, t string")
    got = df.select("k", times.grounded(F.col("t"), F.lit(str(NOW)).cast("timestamp")).alias("g")).orderBy("k")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    got = got.select("g.precision", text("g.onset").alias("o"), text("g.earliest").alias("a"), text("g.before").alias("b")).collect()
    for (t, onset, part), r in zip(cases, got):
        if onset is None:
            assert r["precision"] == part and (r["o"] == (None if part == "vague" else str(NOW))), t
            continue
        day = onset.replace(hour=0, minute=0, second=0)
        start = {"minute": onset.replace(second=0), "hour": onset.replace(minute=0, second=0), "day": day, "week": day - datetime.timedelta(days=day.weekday()), "month": day.replace(day=1), "year": day.replace(month=1, day=1)}[part]
        assert (r["precision"], r["o"], r["a"]) == ("exact", str(onset), str(start)) and r["a"] <= r["o"] < r["b"], t


def test_elapsed(spark):
    cases = [(0, "刚刚"), (59, "刚刚"), (60, "1分钟"), (3599, "59分钟"), (3600, "1小时"), (86399, "23小时"), (86400, "1天"), (86400 + 3600, "1天1小时"), (200000, "2天7小时"), (-1, None)]
    df = spark.createDataFrame([(s,) for s, _ in cases], "s int")
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    assert [r[0] for r in df.select(times.elapsed(F.timestamp_seconds(F.lit(1_700_000_000) - F.col("s")), now)).collect()] == [x for _, x in cases]
    assert [r[0] for r in spark.createDataFrame([("多久了",), ("好",), (None,)], "t string").select(times.asks_how_long(F.col("t"))).collect()] == [True, False, False]
