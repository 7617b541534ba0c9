"""Named queries of the engine and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import anchors, archives, carry, cycles, depth, diffs, fair_values, orders, quotes, screening, stored_files, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _part in (quotes, cycles, depth, orders, fair_values, carry, screening, archives, anchors, diffs, streams, stored_files):
    QUERIES.update(_part.QUERIES)
    ORACLE.update(_part.ORACLE)
FLAGSHIP = "episodes"
