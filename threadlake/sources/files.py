"""Readers and writers of files: project folders, session bundles, landed payloads, metric exports."""

from __future__ import annotations

import base64
import binascii
import gzip
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# FIXED values: folders and endings of files that a project scan passes over.
IGNORED_FOLDERS = "node_modules .git dist build .next out coverage .turbo __pycache__ .venv venv target .cargo vendor".split()
IGNORED_ENDINGS = "png jpg jpeg gif svg ico woff woff2 ttf eot mp4 mp3 zip tar gz pdf lock map webp avif tiff bmp exe dll so dylib class pyc".split()


def _relative(root: str) -> Column:
    return F.regexp_replace("path", rf"^(?:file:)?/*\Q{root.removeprefix('file:').strip('/')}\E/+", "")


def project_files(spark: SparkSession, root: str, max_bytes: int = 200_000, depth: int = 6) -> DataFrame:
    """(path, size, text) of a folder's text files: not below ignored folders, not with ignored endings, not larger than
    max_bytes, in at most `depth` folders; folders' files come sorted by path when ordered by it. Spark lists and reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).withColumn("path", _relative(root))
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    kept = files.filter((F.col("length") <= max_bytes) & (F.size(folders) <= depth) & ~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_FOLDERS))))
    kept = kept.filter(~F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(IGNORED_ENDINGS))
    return kept.select("path", F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


def _unpack(bundle: str | None) -> str | None:
    """The JSON text in a gzip in base64; None for anything else."""
    try:
        return gzip.decompress(base64.b64decode(bundle or "", validate=True)).decode("utf-8")
    except (binascii.Error, gzip.BadGzipFile, EOFError, zlib.error, UnicodeDecodeError):
        return None


def bundled_sessions(bundles: DataFrame, column: str = "data") -> DataFrame:
    """(session_id, messages array<struct<role, content>>) of bundles (data): JSON lists of sessions, gzipped, in base64.
    A bundle that can't be read gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                try:
                    sessions = json.loads(_unpack(bundle) or "[]")
                except ValueError:
                    sessions = []
                texts = [json.dumps(s) for s in sessions if isinstance(s, dict)] if isinstance(sessions, list) else []
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["session"])

    one = F.from_json("session", "id string, messages array<struct<role string, content string>>").alias("s")
    return bundles.select(column).mapInArrow(run, "session string").select(one).select(F.col("s.id").alias("session_id"), "s.messages").filter("session_id IS NOT NULL")


def landed_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Payloads of an ingest folder, one JSON object a line; malformed lines stand in the column broken."""
    schema = "id string, platform string, title string, messages array<struct<role string, content string>>, broken string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)


def write_metrics(metrics: DataFrame, path: str, cutoff: int, at: str = "at_s") -> None:
    """The metrics after a point in time as JSON lines."""
    metrics.filter(F.col(at) > cutoff).write.mode("overwrite").json(path)


def html_text(html: Column) -> Column:
    """Text of a page's HTML: scripts, styles, comments and controls go, preformatted blocks become fences, breaks and
    blocks become line feeds, entities characters. Plain expressions, so that it runs in the JVM."""
    out = F.regexp_replace(html, r"(?is)<(script|style|button|svg|noscript)\b.*?</\1\s*>|<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<pre\b[^>]*>\s*(?:<code\b(?:[^>]*?language-([\w-]+))?[^>]*>)?(.*?)(?:</code\s*>)?\s*</pre\s*>", "\n```$1\n$2\n```\n")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</?(?:p|div|section|article|header|footer|nav|ul|ol|li|h[1-6]|table|tr|blockquote|main|aside)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for entity, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(character))
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")
