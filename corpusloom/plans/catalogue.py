"""All registered queries of the library and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import collections, dictionary, files, files_of, memory, metadata, retrieval, review, rules, segmentation, splitting, stateful, telemetry, times, upkeep, versioning

_AREAS = (telemetry, versioning, retrieval, memory, rules, review, metadata, upkeep, files, segmentation, stateful, collections, files_of, splitting, times, dictionary)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for area in _AREAS for k, f in area.QUERIES.items()}
ORACLES: dict[str, str] = {k: sql for area in _AREAS for k, sql in area.ORACLES.items()}
FLAGSHIP = "hybrid_retrieval"
