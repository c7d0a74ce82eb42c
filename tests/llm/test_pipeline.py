"""The pipeline on a small table against a plain version of each stage."""

from collections import Counter

import pytest

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and returned."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, docs, SMALL).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_columns(stages):
    assert len(stages) == 5
    assert all(after.columns == COLUMNS for _, _, after in stages[:-1])


def test_each_stage_works_on_what_its_predecessor_kept(stages):
    from tests.llm.test_operators import brute_components, brute_lines

    language, lines, near, mixed, coded = stages
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in language[1:])
    assert set(after) <= set(before) and all(any(map(str.isalpha, before[i])) for i in after)
    assert len(after) >= 0.95 * len(before)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in lines[1].collect()]
    assert sorted((r["doc_id"], r["text"]) for r in lines[2].collect()) == brute_lines(rows, 2)
    assert all(r["n_chars"] == len(r["text"]) for r in lines[2].collect())
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in near[1].collect()]
    keep = {i for i, n, c in brute_components(rows) if not n or c == i}
    assert sorted(r["doc_id"] for r in near[2].collect()) == sorted(keep)
    copies = Counter(r["doc_id"] for r in mixed[2].collect())
    assert set(copies) <= keep and max(copies.values()) <= 2
    assert Counter(r["doc_id"] for r in coded[2].collect()) == copies


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages[-1][2].collect()))
