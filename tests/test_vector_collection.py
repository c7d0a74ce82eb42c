"""The vector collection against brute force: batches, deletes, replacement, probes and pruned folders."""

import random

import numpy as np
import pytest

from corpusloom.operators import vector_collection
from corpusloom.operators.vector_collection import VectorCollection


def frame(spark, rows, key="chunk_id", v="v"):
    return spark.createDataFrame(list(rows.items()), f"{key} long, {v} array<double>")


def brute(rows, queries, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    good = {i: unit(v) for i, v in rows.items() if v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q, w in queries.items():
        scored = sorted((-round(float(unit(w) @ v), 6), i) for i, v in good.items() if i != q)[:k]
        out += [(q, i, n, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def hits(frame):
    return sorted((r["query_id"], r["chunk_id"], r["rank"], r["score"]) for r in frame.collect())


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(12, 8))
    return {seed * 1000 + k: (centres[k % 12] + rng.normal(size=8) * 0.05).tolist() for k in range(n)}


@pytest.mark.parametrize("piece, chunk", [(1 << 14, 512), (7, 3)])
def test_collection(spark, tmp_path, monkeypatch, piece, chunk):
    monkeypatch.setattr(vector_collection, "PIECE", piece)
    monkeypatch.setattr(vector_collection, "CHUNK", chunk)
    rows = clustered(200, 1)
    odd = {9001: None, 9002: [0.0] * 8, 9003: [1.0] * 7, 9004: [float("nan")] * 8, 9005: [None] + [1.0] * 7}
    queries = {1000: rows[1000], 1007: rows[1007], 5: rows[1003], 6: [1e-9] * 8}
    c = VectorCollection(spark, f"file://{tmp_path}")
    c.create(frame(spark, rows | odd), 12)
    asked = frame(spark, queries | {7: [0.0] * 8}, "query_id", "q")
    assert hits(c.search(asked, 5)) == brute(rows, queries, 5)
    more = clustered(60, 2)
    c.add(frame(spark, more | odd))
    rows |= more
    assert hits(c.search(asked, 5)) == brute(rows, queries, 5)
    gone = [i for i in rows if i % 3 == 0]
    c.delete(frame(spark, {i: None for i in gone}))
    for i in gone:
        del rows[i]
    back = {gone[0]: [float(x) for x in range(1, 9)], 1001: [float(x) for x in range(8, 0, -1)]}
    c.add(frame(spark, back), replace=True)
    rows |= back
    assert hits(c.search(asked, 300)) == brute(rows, queries, 300)
    assert {r["chunk_id"] for r in c.rows().collect()} == set(rows)
    assert sum(r["n"] for r in c.info().collect()) == len(rows)
    # near vectors share lists, so few probes find nearly all
    some = frame(spark, {i: rows[i] for i in list(rows)[:40]}, "query_id", "q")
    assert c.probes_for(some, 5, 0.9) <= 4
    assert np.mean([r["recall"] for r in c.recall(some, 5, 4).collect()]) >= 0.9


def test_only_probed_folders_are_read(spark, tmp_path):
    c = VectorCollection(spark, f"file://{tmp_path}")
    c.create(frame(spark, clustered(120, 3)), 12)
    plan = c.rows([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert {r["list"] for r in c.rows([1, 2]).select("list").distinct().collect()} <= {1, 2}


def test_writer_that_dies_adds_nothing(spark, tmp_path, monkeypatch):
    rows = {k: [float(x) for x in random.Random(k).choices(range(1, 9), k=8)] for k in range(30)}
    c = VectorCollection(spark, f"file://{tmp_path}")
    c.create(frame(spark, rows), 4)
    monkeypatch.setattr(VectorCollection, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        c.add(frame(spark, {99: [1.0] * 8}))
    monkeypatch.undo()
    assert {r["chunk_id"] for r in VectorCollection(spark, f"file://{tmp_path}").rows().collect()} == set(rows)


def test_empty_collection(spark, tmp_path):
    c = VectorCollection(spark, f"file://{tmp_path}")
    c.create(frame(spark, {1: None}), 4)
    assert c.rows().collect() == [] and c.search(frame(spark, {1: [1.0]}, "query_id", "q"), 3).collect() == []
    c.create(frame(spark, {1: [1.0, 2.0]}), 4)
    assert c.info().collect()[0]["n"] == 1
    c.drop()
    assert not tmp_path.exists()


def test_recall_at_is_what_searches_find_from_one_exact_search(spark, tmp_path, monkeypatch):
    rows = clustered(150, 4)
    c = VectorCollection(spark, f"file://{tmp_path}")
    c.create(frame(spark, rows), 12)
    some = frame(spark, {i: rows[i] for i in list(rows)[:20]} | {7: [0.0] * 8}, "query_id", "q")
    calls, best = [], vector_collection.best_of_lists
    monkeypatch.setattr(vector_collection, "best_of_lists", lambda *a, **b: calls.append(1) or best(*a, **b))
    got = {r["query_id"]: (r["recall"], r["probes"]) for r in c.recall_at(some, 20, 0.9, sample=8).collect()}
    assert len(calls) == 1
    probes = {p for _, p in got.values()}.pop()
    exact = {h[:2] for h in hits(c.search(some, 20))}
    for n in (probes - 1, probes):
        found = {h[:2] for h in hits(c.search(some, 20, n))} if n else set()
        share = {q: round(sum(h in found for h in exact if h[0] == q) / 20, 6) for q in got}
        if n == probes:
            assert {q: r for q, (r, _) in got.items()} == share
    assert c.probes_for(some, 20, 0.9, sample=8) == probes
