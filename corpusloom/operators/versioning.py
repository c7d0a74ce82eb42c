"""Chunk identity, versions and lifecycle: set-oriented rewrites of upserts and clean-ups.

chunks: (source, version, hash, status, is_deleted, updated_at, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash


def enrich(chunks: DataFrame, version: int, status: str, now: Column) -> DataFrame:
    """Adds content hash, chunk id, version, status and time to (source, text)."""
    h = content_hash(F.col("text"))
    return chunks.withColumns({
        "hash": h, "chunk_id": F.concat_ws("_", "source", h), "version": F.lit(version), "status": F.lit(status), "updated_at": now,
    })


def active_hashes(chunks: DataFrame) -> DataFrame:
    return chunks.filter("status = 'active' and not is_deleted").select("source", "hash").distinct()


def changed(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New chunks whose hash isn't active for their source."""
    return new.join(existing, ["source", "hash"], "left_anti")


def unchanged(new: DataFrame, existing: DataFrame) -> DataFrame:
    return new.join(existing, ["source", "hash"], "left_semi")


def document_versions(chunks: DataFrame) -> DataFrame:
    """The highest version of each source that isn't deleted, 0 if all are."""
    v = F.max(F.when(~F.col("is_deleted"), F.col("version")))
    return chunks.groupBy("source").agg(F.coalesce(v, F.lit(0)).alias("version"))


def activate_and_deprecate(chunks: DataFrame) -> DataFrame:
    """Pending chunks of each source's newest version become active if their hashes are unique.

    Older active chunks are deprecated, but of a hash that the newest version keeps only the
    highest version stays active.
    """
    newest = F.max("version").over(W.partitionBy("source"))
    pending = (F.col("status") == "pending") & (F.col("version") == F.col("newest"))
    alike = F.count(F.when(pending, F.lit(1))).over(W.partitionBy("source", "hash", "version"))
    marked = chunks.withColumn("newest", newest).withColumn("pending_alike", alike)
    ready = F.max("pending_alike").over(W.partitionBy("source")) == 1
    marked = marked.withColumn("ready", ready)
    kept = F.max(F.when(F.col("version") == F.col("newest"), F.lit(1))).over(W.partitionBy("source", "hash")).isNotNull()
    marked = marked.withColumn("kept", kept)
    top = F.max(F.when((F.col("status") == "active") & F.col("kept"), F.col("version"))).over(W.partitionBy("source", "hash"))
    older = (F.col("status") == "active") & (F.col("version") < F.col("newest"))
    status = (
        F.when(pending & F.col("ready"), "active")
        .when(older & F.col("ready") & (~F.col("kept") | (F.col("version") < F.col("top"))), "deprecated")
        .otherwise(F.col("status"))
    )
    return marked.withColumn("top", top).withColumn("status", status).select(*chunks.columns)


def cleanup_deprecated(chunks: DataFrame, now: Column, seconds: int) -> DataFrame:
    """What stays after deprecated chunks older than ``seconds`` are deleted."""
    old = (F.col("status") == "deprecated") & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(seconds)))
    return chunks.filter(~old)


def soft_delete(chunks: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Chunks of the sources marked as deleted."""
    hit = sources.select("source", F.lit(True).alias("hit")).distinct()
    return chunks.join(hit, "source", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("hit", F.lit(False))).withColumn(
        "updated_at", F.when(F.col("hit"), now).otherwise(F.col("updated_at"))
    ).drop("hit")


def stale_documents(disk: DataFrame, index: DataFrame, hours: float) -> DataFrame:
    """Sources whose file is newer than their index entry by more than ``hours``; unindexed ones are left out."""
    newest = index.groupBy("source").agg(F.max("updated_at").alias("indexed_at"))
    lag = (F.unix_micros("modified_at") - F.unix_micros("indexed_at")) / 3.6e9
    return disk.join(newest, "source").withColumn("lag_hours", F.round(lag, 1)).filter(lag > hours)


def reconcile(disk: DataFrame, index: DataFrame) -> DataFrame:
    """(source, state): only on disk, or only in the index."""
    d, i = disk.select("source").distinct(), index.filter("not is_deleted").select("source").distinct()
    return (
        d.join(i, "source", "left_anti").withColumn("state", F.lit("disk_only"))
        .unionByName(i.join(d, "source", "left_anti").withColumn("state", F.lit("index_only")))
    )


def fingerprint(chunks: DataFrame) -> DataFrame:
    """One row: a digest of all active hashes in order, the same in any order of rows; null without any.

    Hashes are digested in 256 buckets by their first two digits, then the buckets in order.
    """
    per = chunks.filter("status = 'active'").select("hash").distinct().groupBy(F.substring("hash", 1, 2).alias("bucket"))
    part = per.agg(F.md5(F.array_join(F.array_sort(F.collect_list("hash")), "|")).alias("digest"))
    listed = F.collect_list(F.struct("bucket", "digest"))  # 256
    return part.agg(F.when(F.count("digest") > 0, F.md5(F.array_join(F.array_sort(listed)["digest"], "|"))).alias("kb_version"))


def exact_duplicates(chunks: DataFrame) -> DataFrame:
    """Groups of equal content: hash, members, and the least id."""
    return chunks.groupBy("hash").agg(F.count("*").alias("members"), F.min("doc_id").alias("first_id")).filter("members > 1")


def latest_by_base(docs: DataFrame) -> DataFrame:
    """Of documents named base_v<version> the latest per base, by date and version as strings; others stay."""
    base = F.regexp_extract("name", r"^(.*)_v[^_]*$", 1)
    nth = F.row_number().over(W.partitionBy("base").orderBy(F.col("effective").desc(), F.col("version").desc(), "name"))
    marked = docs.withColumn("base", F.when(base != "", base).otherwise(F.col("name")))
    return marked.withColumn("nth", nth).filter((F.col("nth") == 1) | (F.col("base") == F.col("name"))).drop("nth")


def validate_shadow(built: DataFrame, expected: int) -> DataFrame:
    """One row: rows found, share of the expected, pending rows, verdict."""
    out = built.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "pending").alias("pending"))
    verdict = F.when(F.col("n") == 0, "error").when((F.col("n") < 0.9 * expected) | (F.col("pending") > 0), "warning").otherwise("ok")
    return out.select("n", (F.col("n") / expected).alias("share"), "pending", verdict.alias("verdict"))


def vote(claims: DataFrame) -> DataFrame:
    """Per document and field the value most sources claim; ties go to the source of best priority.

    claims: (doc_id, field, value, priority). Adds how many distinct values were claimed.
    """
    n = claims.filter("value is not null").groupBy("doc_id", "field", "value").agg(F.count("*").alias("votes"), F.min("priority").alias("best"))
    nth = F.row_number().over(W.partitionBy("doc_id", "field").orderBy(F.col("votes").desc(), "best", "value"))
    claimed = F.count("*").over(W.partitionBy("doc_id", "field"))
    return n.withColumns({"nth": nth, "n_values": claimed}).filter("nth = 1").drop("nth", "best")


def restore(chunks: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Deleted chunks of the sources are live again."""
    hit = sources.select("source", F.lit(True).alias("hit")).distinct()
    back = F.coalesce("hit", F.lit(False)) & F.col("is_deleted")
    out = chunks.join(hit, "source", "left").withColumn("back", back)
    out = out.withColumns({"is_deleted": F.col("is_deleted") & ~F.col("back"), "updated_at": F.when(F.col("back"), now).otherwise(F.col("updated_at"))})
    return out.select(*chunks.columns)


def purge(chunks: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """What stays once chunks deleted more than ``days`` ago are gone; a deletion without a time stays."""
    gone = F.col("is_deleted") & (F.col("deleted_at") < now - F.make_dt_interval(days=F.lit(days)))
    return chunks.filter(~F.coalesce(gone, F.lit(False)))


def activate_pending(chunks: DataFrame, now: Column) -> DataFrame:
    """Pending chunks become active; adds activated_at."""
    pending = F.col("status") == "pending"
    return chunks.withColumns({"activated_at": F.when(pending, now), "status": F.when(pending, "active").otherwise(F.col("status"))})


def embedded_alike(model: Column, dimension: Column, current_model: str, current_dimension: int) -> Column:
    """Whether a chunk's vector is of the current model and size; chunks that don't say so pass."""
    unknown = (F.coalesce(model, F.lit("")) == "") | (F.coalesce(dimension, F.lit(0)) == 0)
    return unknown | (model == current_model) & (dimension == current_dimension)


def newest_entries(log: DataFrame, key: str = "id", most: int = 50) -> DataFrame:
    """The last ``most`` entries of an audit log, newest first."""
    return log.orderBy(F.col(key).desc()).limit(most)
