"""Two captures of every conversation: what is stored and what comes in, longer, shorter, cut or changed by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadlake.sources.tables import table

#: Sessions of captures are numbered from here on, after the authored ones.
FIRST = 1_000_000

_STORED = "conv_id % 7 <> 5 AND turn < 7 - conv_id % 4"
_INCOMING = "conv_id % 7 <> 6 AND turn >= conv_id % 2 AND turn < 8 - conv_id % 3 * 3"
_COLUMNS = {
    "stored": ("CASE WHEN (conv_id + turn) % 3 = 0 THEN concat('m', turn) END", "CASE WHEN turn % 2 = 1 AND conv_id % 2 = 0 THEN substr(text, 1, 90 + conv_id % 60) ELSE text END", "conv_id % 50", "CASE WHEN conv_id % 3 = 0 THEN concat('mine ', conv_id) WHEN conv_id % 3 = 1 THEN ' ' END"),
    "incoming": ("CASE WHEN turn % 2 = 0 THEN concat('m', turn) END", "CASE WHEN conv_id % 5 = 0 AND turn <= 1 OR conv_id % 5 = 0 AND turn >= 5 THEN concat('changed ', text) ELSE text END", "conv_id * 7 % 50", "CASE WHEN conv_id % 4 < 2 THEN concat('theirs ', conv_id) END"),
}


def _capture(source: str, where: str) -> str:
    message_id, content, updated_at, name = _COLUMNS[source]
    return f"SELECT conv_id + {FIRST} AS session_id, '{source}' AS source, turn AS message_index, {message_id} AS message_id, role, coalesce({content}, '') AS content, {updated_at} AS updated_at, {name} AS name FROM {{conversations}} WHERE {where}"


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_capture("stored", _STORED), conversations=table(spark, sf_dir, "conversations"))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_capture("incoming", _INCOMING), conversations=table(spark, sf_dir, "conversations"))


#: The same rows for the oracle: which rows there are is data, what is made of them is not.
SQL = f"captures AS ({_capture('stored', _STORED)} UNION ALL {_capture('incoming', _INCOMING)})".replace("{conversations}", "conversations")
