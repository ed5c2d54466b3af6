"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where it is unset and one machine does all, a new local folder."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def short_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Texts are long: Arrow batches of 1,000 rows instead of 10,000 take a third less of an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def partitions(df: DataFrame) -> int:
    """The number of partitions that the session shuffles into."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that a lost executor costs a read, not a recount."""
    path = f"{shared_dir(df.sparkSession)}/threadlake/{name}-{uuid.uuid4().hex}"
    # Small row groups: what a writer holds of a task adds to what its Python worker holds.
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete what `durable` wrote for tables that nothing reads any more; tables from elsewhere are left alone."""
    for table in tables:
        spark = table.sparkSession
        root = f"{shared_dir(spark)}/threadlake/"
        for path in {file[: file.rindex("/")] for file in table.inputFiles()}:
            if path.removeprefix("file:").lstrip("/").startswith(root.removeprefix("file:").lstrip("/")):
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
