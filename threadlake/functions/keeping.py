"""Tables that a plan reads several times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel


def once(rows: DataFrame) -> DataFrame:
    """The rows, found by the first branch of a plan that reads them and kept on the executors' disks for the others: without
    that the planner works each branch out anew, patterns over whole texts too. What a lost executor held is worked out again."""
    # The name keeps a union from being merged with later ones, whose plan would not be that of the kept rows.
    return rows.persist(StorageLevel.DISK_ONLY).alias("once")
