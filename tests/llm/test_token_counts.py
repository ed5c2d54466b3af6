import random

import public_tokenizers
from tokenizers import Tokenizer, models, normalizers

from threadlake.llm import queries, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a", " ", "  ", "a ", " a", "a  b", "\n", "a\n b", "\n\na \n", "日本語 テキスト梦", "😀😀 x😀", "<s> <0x0A>", "▁a ▁", "tab\there", "İß ﬁ", "x" * 400, "ab" * 300, "\x00\x01", " \n ", "a\n\n", "Hello  wörld 😀\n\tx"]


def library(texts, pieces):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_same_as_library(spark):
    draw = random.Random(2)
    texts = ODD + ["".join(draw.choice("abcdeéßthingsr  .!\n ÀÉ梦😀") for _ in range(draw.randint(1, 300))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(9999, None, 1)], "doc_id long, text string, n_tokens int").repartition(2)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PATH).collect()}
    for i, (t, n) in enumerate(zip(texts, library(texts, token_counts.vocabulary(PATH)))):
        assert got[i] == n, (t, got[i], n)
    assert got[9999] == 0 and token_counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_ties_go_to_the_longest_last_piece():
    draw = random.Random(7)
    for _ in range(40):
        pieces = [("<unk>", 0.0), ("▁", -1.0), *((p, -float(draw.randint(0, 3))) for p in {"".join(draw.choice("ab▁" if k == 0 else "ab") for k in range(draw.randint(1, 4))) for _ in range(8)} - {"▁"})]
        counter = token_counts.UnigramCounter(pieces)
        texts = ["".join(draw.choice("ab") for _ in range(draw.randint(1, 30))) for _ in range(20)]
        t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
        for x in texts:
            ids = t.encode("▁" + x, add_special_tokens=False).ids
            if 0 not in ids:
                assert counter.text(x) == len(ids), (pieces, x)


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in queries.op3_token_counts(spark, d).collect()}
    assert [got[r.doc_id] for r in rows] == library([r.text or "" for r in rows], token_counts.vocabulary(PATH))
