import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SMALL).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def normal(rows):
    """Rows as sorted tuples of text, floats to nine digits."""

    def cell(v):
        if v is None or isinstance(v, float) and v != v:
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.fixture(scope="session")
def agrees(spark, duck):
    """Asserts that a registered query and its SQL give the same rows."""

    def check(query, sql):
        got = query(spark, SMALL)
        want = duck.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        have = normal(got.select(*cols).toPandas().astype(object).itertuples(index=False, name=None))
        assert have == normal(want.df()[cols].astype(object).itertuples(index=False, name=None))

    return check
