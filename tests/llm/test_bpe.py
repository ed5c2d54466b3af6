import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from threadlake.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "a", "Hello World's don't we'll I'D", "ΟΔΥΣΣΕΥΣ Σ", "İstanbul ǅ ß ﬁ", "é Å ẛ̣", "日本語テキスト 123４５", "a\x1cb\x85c d　e",
    "<|endoftext|>abc<|startoftext|> <|ENDOFTEXT|>", "x" * 500, "ab" * 400, "!?" * 300, "😀👩‍👩‍👧 ok", "\x00\x01 ﻿", "  tabs\t\tnew\nlines  ", "é" * 200 + "<|endoftext|",
]


def library(texts):
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    out = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    return out, [t.decode(i, skip_special_tokens=False) for i in out]


def test_same_as_library(spark):
    draw = random.Random(5)
    texts = ODD + ["".join(draw.choice("abcdeéßñ'ts 12.!\n ÀÉ") for _ in range(draw.randint(1, 400))) for _ in range(200)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(len(texts), None, None)], "doc_id long, text string, token_ids string")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(rows, PATH), PATH).collect()}
    ids, decoded = library(texts)
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].token_ids, "<u4").tolist() == ids[i], repr(t)
        assert got[i].decoded == decoded[i], repr(t)
    assert bytes(got[len(texts)].token_ids) == b"" and got[len(texts)].decoded == ""


def test_both_merges_agree():
    b = bpe.load(PATH)
    draw = random.Random(1)
    for _ in range(300):
        raw = "".join(draw.choice("aeinrst") for _ in range(draw.randint(1, 90))).encode()
        parts = [b.inner[x] for x in raw[:-1]] + [b.final[raw[-1]]]
        assert b._scan(list(parts)) == b._heap(list(parts))


def test_query_over_documents(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op9_bpe(spark, d).collect()}
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    ids, decoded = library([r.text or "" for r in rows])
    for r, i, t in zip(rows, ids, decoded):
        assert got[r.doc_id].n_tokens == len(i)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none, PATH), PATH).count() == 0


def test_one_python_worker_a_task(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for made in (queries.op9_bpe(spark, d), corpus_pipeline.encoding_stage(spark, docs, d)):
        assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_one_pass_is_both(spark):
    rows = spark.createDataFrame([*enumerate(ODD), (len(ODD), None), (None, "no id"), (0, "id again")], "doc_id long, text string")
    one, two = bpe.encode_and_decode(rows, PATH), bpe.decode(bpe.encode(rows, PATH), PATH)
    assert one.schema == two.schema
    both = [sorted((str(r.doc_id), bytes(r.token_ids), r.decoded) for r in x.collect()) for x in (one, two)]
    assert both[0] == both[1] and len(both[0]) == len(ODD) + 3


def test_a_task_leaves_no_words(spark):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words", "x " * (1 << 20)]})
    held, out = [], []
    for made in bpe._passed(iter([batch]), PATH, True, True):
        held.append(len(bpe.load(PATH).store))
        out.append(made.num_rows)
    assert out == [1, 1] and held[0] and not bpe.load(PATH).store
