import random
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from threadlake.llm import queries, toxicity

D = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = queries.op6_toxicity(spark, D).join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    hit = sum(r.predicted and r.toxic for r in rows)
    precision, recall = hit / max(1, sum(r.predicted for r in rows)), hit / sum(r.toxic for r in rows)
    assert precision > 0.85 and recall > 0.85, (precision, recall)


def test_every_document_once(spark):
    d = "/root/testdata/sf0.001"
    got = queries.op6_toxicity(spark, d)
    assert got.select("doc_id").exceptAll(spark.read.parquet(f"{d}/documents.parquet").select("doc_id")).count() == 0
    assert got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_odd_rows(spark):
    draw = random.Random(3)
    plain = lambda: " ".join(draw.choice("river stone cloud meadow lamp table window garden".split()) for _ in range(30))
    texts = [plain() + (" vileword" if i % 5 == 0 else "") for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (None, "vileword", "x"), (5, texts[5], "x"), (902, "vileword " * 50_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == 305
    for r in rows:
        expected = 0 if r.doc_id in (900, 901) else int(r.doc_id is None or r.doc_id == 902 or r.doc_id % 5 == 0)
        assert r.predicted == expected, r
    assert toxicity.classify(docs, labels.filter("toxic = 0")).filter("score > 0").count() == 0
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a[0] == b[0] and np.allclose(a[1], b[1])
