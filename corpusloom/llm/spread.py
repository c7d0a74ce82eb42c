"""Joins whose keys may hold a large share of all rows.

Keys that hold more than one HOT_KEYS-th of the rows of the large side are fewer than HOT_KEYS,
so their digests may be broadcast. Their rows are dealt over pieces by a digest, and the side
with one row a key gets a row for each piece. Two keys of equal digest only share pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1024


def hot_keys(counts: DataFrame, n: str, *key: str, least: int = 4096) -> DataFrame:
    """(hot, pieces) for the hot keys of a table that has a row for each key and their number ``n``."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    most = max(least, -(-total // HOT_KEYS))
    return counts.filter(F.col(n) > most).select(F.xxhash64(*key).alias("hot"), F.ceil(F.col(n) / most).cast("int").alias("pieces"))


def dealt(many: DataFrame, hot: DataFrame, key: list[str], by: Column, piece: str = "piece") -> DataFrame:
    """The large side with a column ``piece``; ``by`` tells a key's rows apart."""
    marked = many.join(F.broadcast(hot), F.xxhash64(*key) == F.col("hot"), "left")
    return marked.withColumn(piece, F.pmod(by, F.coalesce("pieces", F.lit(1))).cast("int")).drop("hot", "pieces")


def copied(few: DataFrame, hot: DataFrame, key: list[str], piece: str = "piece") -> DataFrame:
    """The side with one row a key, once for each of the key's pieces."""
    marked = few.join(F.broadcast(hot), F.xxhash64(*key) == F.col("hot"), "left")
    return marked.withColumn(piece, F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("hot", "pieces")
