import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from threadlake.llm import perplexity, queries

D = "/root/testdata/sf0.1"


class Brute:
    """Interpolated modified Kneser-Ney over bytes, from dictionaries."""

    def __init__(self, texts, order=perplexity.ORDER):
        self.order = order
        self.c = {order: Counter(g for t in texts for g in self.grams(t))}
        for n in range(order - 1, 0, -1):
            self.c[n] = Counter(g[1:] for g in self.c[n + 1])
        self.d, self.total, self.freed = {}, {}, {}
        for n, c in self.c.items():
            of = Counter(c.values())
            y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
            self.d[n] = [min(k, max(0.0, k - (k + 1) * y * of[k + 1] / of[k])) if of[k] else k / 2 for k in (1, 2, 3)] if of[1] else [0.0] * 3
            self.total[n], self.freed[n] = defaultdict(int), defaultdict(float)
            for g, x in c.items():
                self.total[n][g[:-1]] += x
                self.freed[n][g[:-1]] += self.d[n][min(x, 3) - 1]

    def grams(self, text):
        data = b"\n" * (self.order - 1) + text.encode()
        return [data[i : i + self.order] for i in range(len(data) - self.order + 1)]

    def p(self, g):
        n = len(g)
        if not n:
            return 1 / 256
        ctx, x = g[:-1], self.c[n][g]
        if ctx not in self.total[n]:
            return self.p(g[1:])
        own = (x - self.d[n][min(x, 3) - 1]) / self.total[n][ctx] if x else 0.0
        return own + max(self.freed[n][ctx] / self.total[n][ctx], 1e-12 if not x else 0.0) * self.p(g[1:])

    def perplexity(self, text):
        found = [math.log(self.p(g)) for g in self.grams(text)]
        return math.exp(-sum(found) / len(found)) if found else None


def test_same_as_brute_force_with_any_number_of_common_grams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars < 3000")
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    brute = [Brute(texts[:25]), Brute(texts[25:])]
    model = perplexity.train(spark.createDataFrame([(int(n >= 25), t) for n, t in enumerate(texts)], "model long, text string"))
    rows = [(i, "en", t, i % 2) for i, t in enumerate([*texts, "", "éèü 日本", "zq" * 2000, texts[3] * 200])] + [(None, "x", "abc", 0), (7, "en", texts[7], 1), (900, "en", None, 1)]
    table = spark.createDataFrame(rows, "id long, lang string, text string, model long")
    for size in (1 << 20, 500, 0):
        got = perplexity.perplexities(table, model, size).collect()
        assert len(got) == len(rows)
        for r in got:
            text, m = ("abc", 0) if r.id is None else (None, 1) if r.id == 900 else (rows[r.id][2], r.id % 2)
            want = brute[m].perplexity(text) if text else None
            assert (r.perplexity is None) == (want is None) and (want is None or math.isclose(r.perplexity, want, rel_tol=1e-9)), (size, r)


def test_held_out_junk_goes_and_clean_texts_stay(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    other = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    rows = perplexity.classify(docs, labels.filter("quality = 1").filter(~other)).join(labels.filter(other), "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad), (sum(good), len(good), sum(bad), len(bad))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "text", None, 2.0), (2, None, "en", 2.0)], "doc_id long, text string, lang string, perplexity double")
    none = spark.createDataFrame([], "doc_id long")
    assert sorted((r.doc_id, r.kept) for r in perplexity.classify(docs, none).collect()) == [(1, True), (2, False)]
    assert perplexity.classify(docs.limit(0), none).count() == 0


def test_query_has_every_document(spark):
    d = "/root/testdata/sf0.001"
    assert queries.op2_perplexity(spark, d).count() == spark.read.parquet(f"{d}/documents.parquet").count()
