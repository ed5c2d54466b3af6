"""Where rows go when code inside tasks needs all rows of a key at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def together(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The rows with equal keys (nulls too) in one task, sorted by the keys and `order`.

    `repartition(keys)` alone is not enough before mapInArrow: where a join or an aggregate below has shuffled by the same
    keys, the planner drops it as needless, and as mapInArrow asks for no distribution, the shuffle that is left may be
    coalesced in another way on each side of a union, read by map tasks, or split where it is skewed. A hash of the keys is no
    partitioning that anything below has, so this shuffle stays."""
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
