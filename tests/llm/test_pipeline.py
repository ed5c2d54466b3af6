import hashlib

import corpus_pipeline
import numpy as np
from tests.llm.test_bpe import library
from tests.llm.test_decontamination import split
from tests.llm.test_near_duplicates import brute as classes
from threadlake.llm import queries

D = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    toxic = {r.doc_id for r in queries.op6_toxicity(spark, D).filter("predicted = 1").collect()}
    assert len(toxic) > 30
    cuts = {" ".join(ws[o : o + 10]) for _, t in items for ws in [split(t)] for o in range(max(1, len(ws) - 9)) if ws}
    assert min(len(split(t)) for _, t in items) >= 10
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, D).cache()
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        gone = before.keys() - after.keys()
        if name == "toxicity":
            assert gone == toxic
        elif name == "near_duplicates":
            of, _ = classes(list(before.items()))
            assert after.keys() == set(of.values())
        elif name == "decontamination":
            whole = {i: split(t) for i, t in before.items()}
            assert gone == {i for i, ws in whole.items() if any(" ".join(ws[p : p + 10]) in cuts for p in range(len(ws) - 9))}
        else:
            assert not gone and sum(before[i] != after[i] for i in after) > 10
        seen.append(len(after))
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
    ids, decoded = library([after[r.doc_id] for r in rows])
    for r, i, t in zip(rows, ids, decoded):
        assert np.frombuffer(r.token_ids, "<u4").tolist() == i and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert {r.doc_id: r.ids_sha256 for r in rows} == {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, D).collect()}


def test_odd_rows_pass(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", None, None), (None, "one text", "en", "s", 8)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.count() == 4


def test_every_stage_takes_odd_tables(spark):
    d = "/root/testdata/sf0.001"
    columns = "doc_id long, text string, lang string, source string, n_chars long, id long, component string, score double"
    long = "a very long text of words " * 8_000
    rows = [(1, long, "en", "s", len(long), 7, "x", 0.5), (2, long, "en", "s", len(long), 7, "x", 0.5), (3, "short one", None, None, 9, None, None, None), (3, "short one", None, None, 9, None, None, None), (4, "", "en", "s", 0, 1, "x", 0.1)]
    for docs, sizes in ((spark.createDataFrame([], columns), [0, 0, 0, 0, 0]), (spark.createDataFrame(rows, columns), [5, 4, 4, 4, 4])):
        for (_, stage), size in zip(corpus_pipeline.STAGES, sizes):
            before, docs = docs.columns, stage(spark, docs, d).cache()
            assert docs.count() == size
            assert docs.columns == before or stage is corpus_pipeline.STAGES[-1][1]
