"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positive sample P; a sample U of all training documents, whatever their labels, is
the unlabelled one. A logistic model minimises the risk  prior * R+(P) + max(0, R-(U) - prior * R-(P)),  the estimator
of Kiryo and others (2017); while the second part is negative, its gradient is followed upwards. Its inputs are words in
lower case, digits and masks inside them included, and their beginnings of PREFIXES letters, each counted once in a
document; words of scripts without spaces give their pairs of characters too. An L1 and an L2 penalty choose and shrink
the weights, of both signs.

The sizes of both samples and of the feature set are parameters (max_positive, max_unlabelled, max_features): rows with
the lowest hash of their id are taken, so that more rows do not change the size of what is collected, and the features
whose shares in the two samples differ most by their standard error, in either direction. The class prior is the share of
toxic rows among all training labels, which takes the labelled rows for a random sample of all. Scoring reads every
whole text.

Results: a null or empty text gets the score of a text without any feature; without positive labels all scores are 0;
a document labelled twice is toxic if one label says so; rows with a null id are scored, and never train; repeated rows
are each scored; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from threadlake.llm.packed import parts
from threadlake.llm.storage import durable

PREFIXES = (5, 7, 9, 11)
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¿¡"
_PIECES = regex.compile(r"[\p{L}\p{N}\p{M}@$!*'-]+").findall
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]").search
#: Words whose features a task remembers, and features that it counts before it hands them on.
_CACHE, _COUNTED, _CACHED_LENGTH = 50_000, 200_000, 40


def held_out(id_col: str = "doc_id"):
    """The rows that no label may be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def word_features(token: str) -> list[str]:
    """Of a run of characters between spaces, in lower case."""
    word = token.strip(_EDGE)
    found = []
    for piece in [word] if word.isalnum() else _PIECES(word):
        if word := piece.strip("@$!*'-"):
            found.append(f"{word}$")
            found += [word[:n] for n in PREFIXES if n < len(word)]
            if not word.isascii() and _UNSPACED(word):
                found += [f"{word[i : i + 2]}~" for i in range(len(word) - 1)]
    return found


class _Features(dict):
    """Features of a token, or with places the places of those in it."""

    def __init__(self, places: dict[str, int] | None = None):
        super().__init__()
        self.places = places

    def __missing__(self, token: str) -> tuple:
        found = tuple(word_features(token))
        if self.places is not None:
            found = tuple(self.places[f] for f in found if f in self.places)
        if len(self) < _CACHE and len(token) <= _CACHED_LENGTH:
            self[token] = found
        return found

    def of(self, text: str | None) -> list:
        found = set()
        for token in set((text or "").lower().split()):
            if f := self[token]:
                found.update(f)
        return sorted(found)


def _training(docs: DataFrame, labels: DataFrame, id_col: str, max_positive: int, max_unlabelled: int) -> tuple[DataFrame, float, int]:
    """(text, positive) of the two samples, the class prior and the number of positive labels."""
    order = F.xxhash64(id_col)
    usable = ~held_out(id_col) & F.col(id_col).isNotNull()
    marks = labels.filter(usable).groupBy(id_col).agg(F.max(F.coalesce("toxic", F.lit(0))).cast("int").alias("toxic"))
    n, toxic = marks.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    lowest = lambda ids, most: ids.orderBy(order, id_col).limit(most)
    ids = docs.filter(usable).select(id_col).distinct()
    positive = lowest(ids.join(marks.filter("toxic = 1"), id_col, "left_semi"), max_positive).withColumn("positive", F.lit(1))
    chosen = positive.unionByName(lowest(ids, max_unlabelled).withColumn("positive", F.lit(0)))
    # Bounded by max_positive + max_unlabelled rows of two numbers.
    texts = docs.filter(usable).select(id_col, "text").join(F.broadcast(chosen), id_col).select("positive", "text")
    return durable(texts, "toxicity-sample"), toxic / n if n else 0.0, toxic


def _counted(sample: DataFrame) -> DataFrame:
    """(feature, p, u): in how many texts of each sample it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, seen = _Features(), (Counter(), Counter())

        def flush(positive: int) -> pa.RecordBatch:
            keys, n = list(seen[positive]), pa.array(list(seen[positive].values()), pa.int64())
            seen[positive].clear()
            zero = pa.array(np.zeros(len(keys), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *((n, zero) if positive else (zero, n))], ["feature", "p", "u"])

        for batch in batches:
            for part in parts(batch, 1):
                for positive, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    seen[positive].update(features.of(text))
                    if len(seen[positive]) > _COUNTED:
                        yield flush(positive)
        for positive in (0, 1):
            yield flush(positive)

    part = sample.mapInArrow(run, "feature string, p long, u long")
    return part.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def fit_weights(rows: list[np.ndarray], positive: np.ndarray, width: int, prior: float, rounds: int = 400, l1: float = 3e-4, l2: float = 2e-3) -> np.ndarray:
    """Weights and, last, the bias that minimise the non-negative risk and the penalties; full-batch proximal Adam from
    zero."""
    lengths = np.array([len(r) for r in rows])
    cols = np.concatenate(rows).astype(np.int64)
    row_of = np.repeat(np.arange(len(rows)), lengths)
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    share_p, share_u = positive / max(positive.sum(), 1), (1 - positive) / max((1 - positive).sum(), 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row_of, w[cols], len(rows)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_negative = np.logaddexp(0, z)
        negative_part = (share_u - prior * share_p) @ loss_negative
        d = (share_u - prior * share_p) * p  # of the negative part by z
        d = prior * share_p * (p - 1) + d if negative_part >= 0 else -d
        g = np.append(np.bincount(cols, d[row_of], width), d.sum())
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        scale = np.sqrt(v / (1 - 0.99**t)) + 1e-8
        w -= 0.05 * (m / (1 - 0.9**t)) / scale
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - 0.05 * l1 / scale[:-1], 0)
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_positive: int = 6_000, max_unlabelled: int = 18_000, max_features: int = 4_000) -> tuple[dict[str, int], np.ndarray] | None:
    """The features kept, by their place, and the weights; None without positive labels."""
    sample, prior, positives = _training(docs, labels, id_col, max_positive, max_unlabelled)
    if not positives:
        return None
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return None
    share = (F.col("p") + F.col("u")) / (n_p + n_u)
    apart = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    known = _counted(sample).filter((F.col("p") + F.col("u") >= 3) & (F.col("p") + F.col("u") < n_p + n_u))
    kept = known.orderBy(F.desc(apart), "feature").limit(max_features)
    places = {r["feature"]: n for n, r in enumerate(kept.select("feature").collect())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(places)
        for batch in batches:
            for part in parts(batch, 1):
                found = [features.of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], ["positive", "features"])

    rows = sample.mapInArrow(run, "positive int, features array<int>").toArrow().combine_chunks()  # bounded by both sample sizes
    lists = rows.column("features").combine_chunks()
    flat, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    rows = zip(rows.column("positive").to_pylist(), (flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])))
    rows = sorted(rows, key=lambda r: (r[0], r[1].tobytes()))  # sums in one order, whatever the partitions
    return places, fit_weights([r[1] for r in rows], np.array([r[0] for r in rows], float), len(places), prior)


def scorer(model: tuple[dict[str, int], np.ndarray] | None, docs: DataFrame, text: Column) -> Column:
    """The score of a text column of docs; only it goes to Python, and only numbers come back."""
    if model is None:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # max_features weights at most

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places, weights = shared.value
        features = _Features(places)
        for every in texts:
            z = [weights[features.of(t)].sum() + weights[-1] for part in parts(pa.RecordBatch.from_arrays([every], ["text"]), 0) for t in part.column(0).to_pylist()]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    scored = rows.select(id_col, scorer(fit(rows, labels, id_col), rows, F.col("text")).alias("score"))
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs, with all their columns, less those scored at threshold or above; one pass, without a join."""
    text = F.col(text_col).cast("string")
    model = fit(docs.select(F.col(id_col), text.alias("text")), labels, id_col)
    return docs if model is None else docs.filter(scorer(model, docs, text) < threshold)
