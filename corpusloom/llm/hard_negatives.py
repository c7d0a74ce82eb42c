"""Hard negatives: rows of another label that score near an anchor's positives, but below them.

Rows lie in stripes of about STRIPE and anchors in chunks of about CHUNK, dealt by a digest of
their number; a task meets one chunk and one stripe, so its memory depends on neither the table
nor a label's share of it. For each anchor it computes the integer scores of all rows of the
stripe and sorts them by score and id. The first pass reads the best rows of the anchor's own
label; a window over these takes its positives. The second pass finds each positive's upper
limit in the sorted scores by binary search and reads on through the rows of other labels until
the lower limit; a window over what the stripes gave takes the first ones.

Defined cases: vectors.integer_vectors tells which vectors take part; rows without an id or a
label take no part; vectors of different length have no score and don't meet; a row isn't its
own positive, but another row of equal id may be; scores that tie go to the smaller id; an
anchor without positives gives no rows, nor does a positive with a negative score; an empty
table gives no rows; columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.llm.scratch import Scratch
from corpusloom.llm.vectors import from_bytes, integer_vectors, products, stacked, to_bytes

STRIPE = 8192
CHUNK = 2048
#: Anchors whose scores of a stripe are held at once.
SCORED = 64

_BLOCK = "dim int, uids binary, ids binary, labels binary, vectors binary"


def _pack_vectors(batches):
    for batch in batches:
        dims = batch["v"].map(len).to_numpy()
        for dim in np.unique(dims).tolist():
            rows = batch[dims == dim]
            yield pd.DataFrame({"uid": rows["uid"], "vec_id": rows["vec_id"], "label": rows["label"], "asks": rows["asks"], "dim": dim, "v": to_bytes(stacked(rows["v"], dim))})


def _block(rows: pd.DataFrame) -> dict:
    """Rows in ascending order of ids, so that a stable sort by score breaks ties by id."""
    rows = rows.sort_values(["vec_id", "uid"], kind="stable")
    numbers = {n: rows[c].to_numpy(np.int64).tobytes() for n, c in (("uids", "uid"), ("ids", "vec_id"), ("labels", "label"))}
    return {"dim": int(rows["dim"].iloc[0]), **numbers, "vectors": b"".join(rows["v"])}


def _stripe(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([{"stripe": key[1], **_block(rows)}])


def _chunk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["vec_id", "uid"], kind="stable")
    return pd.DataFrame([{"chunk": key[1], **_block(rows), "positives": [[(int(p["id"]), int(p["score"])) for p in ps] for ps in rows["positives"]]}])


def _opened(frame: pd.DataFrame):
    r = frame.iloc[0]
    uids, ids, labels = (np.frombuffer(r[c], np.int64) for c in ("uids", "ids", "labels"))
    return uids, ids, labels, from_bytes([r["vectors"]], len(uids) * r["dim"]).reshape(len(uids), r["dim"])


def _sorted_scores(asked: pd.DataFrame, stripe: pd.DataFrame):
    """For each anchor of the chunk: (its place, order of the stripe's rows, their scores in it)."""
    uids, _, _, q = _opened(asked)
    own, _, _, x = _opened(stripe)
    for at in range(0, len(q), SCORED):
        scores = products(q[at : at + SCORED], x).astype(np.int64)
        orders = np.argsort(-scores, axis=1, kind="stable")
        for j in range(len(scores)):
            order = orders[j]
            order = order[own[order] != uids[at + j]]
            yield at + j, order, scores[j, order]


def _positives(count: int):
    def run(asked: pd.DataFrame, stripe: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(stripe):
            uids, ids, labels, _ = _opened(asked)
            _, others, kinds, _ = _opened(stripe)
            for a, order, scores in _sorted_scores(asked, stripe):
                same = np.flatnonzero(kinds[order] == labels[a])[:count]
                found += [(int(uids[a]), int(i), int(s)) for i, s in zip(others[order[same]], scores[same], strict=True)]
        return pd.DataFrame(found, columns=["anchor", "id", "score"])

    return run


def _negatives(count: int, low: int, high: int):
    def run(asked: pd.DataFrame, stripe: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(stripe):
            uids, ids, labels, _ = _opened(asked)
            _, others, kinds, _ = _opened(stripe)
            positives = asked["positives"].iloc[0]
            for a, order, scores in _sorted_scores(asked, stripe):
                unlike = np.flatnonzero(kinds[order] != labels[a])
                falling = -scores[unlike]
                for nth, p in enumerate(positives[a]):
                    best, least = int(p["score"]) * high // 100, -(-int(p["score"]) * low // 100)
                    if best < least:
                        continue
                    begin, end = np.searchsorted(falling, -best, "left"), np.searchsorted(falling, -least, "right")
                    for j in unlike[begin : min(end, begin + count)]:
                        found.append((int(uids[a]), nth, int(ids[a]), int(p["id"]), int(p["score"]), int(others[order[j]]), int(scores[j])))
        return pd.DataFrame(found, columns=["anchor", "nth", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def mine(
    embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A negative's score lies between ``low`` and ``high`` hundredths of the positive's.
    """
    scratch = scratch or Scratch(embeddings.sparkSession, "negatives")
    rows = integer_vectors(embeddings, scale, label=F.col("label").cast("long"), asks=F.coalesce(is_anchor, F.lit(False)))
    rows = rows.filter("vec_id is not null and label is not null").withColumn("uid", F.monotonically_increasing_id())
    rows = scratch.table(rows.mapInPandas(_pack_vectors, "uid long, vec_id long, label long, asks boolean, dim int, v binary"))
    n, n_anchors = rows.agg(F.count("*"), F.count_if("asks")).first()
    dealt = lambda name, count, size: F.pmod(F.xxhash64("uid"), F.lit(max(1, -(-count // size)))).alias(name)
    stripes = rows.select("*", dealt("stripe", n, STRIPE)).groupBy("dim", "stripe").applyInPandas(_stripe, "stripe long, " + _BLOCK)
    stripes = scratch.table(stripes)
    anchors = scratch.table(rows.filter("asks").select("*", dealt("chunk", n_anchors, CHUNK)))
    # each chunk meets each stripe of its length: one small row for a pair of blocks, not of vectors
    chunks = anchors.select(F.col("dim").alias("q_dim"), "chunk").distinct()
    ways = scratch.table(stripes.select("dim", "stripe").join(chunks, F.col("dim") == F.col("q_dim")).select("dim", "chunk", "stripe"))
    right = stripes.join(ways, ["dim", "stripe"]).groupBy("dim", "chunk", "stripe")

    def met(anchors: DataFrame, search, schema: str) -> DataFrame:
        packed = scratch.table(anchors.groupBy("dim", "chunk").applyInPandas(_chunk, f"chunk long, {_BLOCK}, positives array<array<struct<id: long, score: long>>>"))
        return packed.join(ways, ["dim", "chunk"]).groupBy("dim", "chunk", "stripe").cogroup(right).applyInPandas(search, schema)

    def first(found: DataFrame, keys: list[str], score: str, id: str, count: int) -> DataFrame:
        nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), id))
        return found.withColumn("rank", nth).filter(F.col("rank") <= count)

    none = F.array().cast("array<struct<id: long, score: long>>")
    best = met(anchors.withColumn("positives", none), _positives(positives), "anchor long, id long, score long")
    best = first(best, ["anchor"], "score", "id", positives).groupBy("anchor")
    # at most ``positives`` of each anchor
    best = best.agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("ranked"))
    best = best.select("anchor", F.transform("ranked", lambda r: F.struct(r["id"].alias("id"), r["score"].alias("score"))).alias("positives"))
    known = anchors.join(best, F.col("uid") == F.col("anchor")).drop("anchor")
    schema = "anchor long, nth int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = first(met(known, _negatives(negatives, low, high), schema), ["anchor", "nth"], "negative_score", "negative_id", negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
