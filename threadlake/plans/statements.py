"""Queries whose statement is the same in Spark SQL and in the oracle's dialect, over the adapted tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadlake.sources.adapters import ADAPTERS


def _with(body: str, dialect: int) -> str:
    names = [n for n in ADAPTERS if re.search(rf"\b{n}\b", body)]
    made = [f"{n} AS ({a if isinstance(a := ADAPTERS[n], str) else a[dialect]})" for n in names]
    head, tail = "WITH " + ", ".join(made), body.strip()
    return f"{head}, {tail[5:]}" if tail[:5].upper() == "WITH " else f"{head} {tail}"


def spark_query(body: str) -> Callable[[SparkSession, str], DataFrame]:
    statement = _with(body, 0)
    tables = sorted(set(re.findall(r"\{(\w+)\}", statement)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(statement, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})

    return run


def oracle(body: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", _with(body, 1)).replace("AS STRING", "AS VARCHAR")
