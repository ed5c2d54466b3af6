"""Quality by perplexity: interpolated modified Kneser-Ney models of byte n-grams, trained on trusted texts.

1. Documents are dealt over FOLDS by their id. A document is scored by the model of the trusted texts of the other folds,
   so that trusted texts, which set the limits, are judged like all others: by a model that has not seen them.
2. Every trusted text is counted: n-grams of ORDER bytes, summed in each task before the shuffle. The counts of lower
   orders are numbers of different continuations to the left, counted from the order above. Discounts come from each
   order's counts of counts; probabilities and back-off weights from joins of the count tables, sharded by n-gram.
3. Every text is read once, where it lies. The COMMON n-grams most often seen in training, a table of fixed size, are
   looked up in the task; of all other n-grams each text hands on its counts. Those are looked up once for all texts, by
   joins sharded by n-gram, and summed for each text. So what texts share most costs no shuffle, what is sent to all tasks
   has one bound at every size, and nothing else of the model leaves its tables.
4. A text is kept if its perplexity lies between two quantiles of the trusted texts of its language, and
   so are all but LOW + 1 - HIGH of texts like them; a language with fewer than LEAST_TRUSTED trusted texts takes the quantiles of all of them.

Results: a null or empty text has no perplexity and isn't kept; without trusted texts every text with bytes is kept; a
null language counts as the empty string; repeated rows are each scored; rows with a null id are scored and never
trusted; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from threadlake.llm.packed import firsts, parts
from threadlake.llm.storage import durable, forget

ORDER, FOLDS = 5, 2
#: N-grams looked up in the tasks, 16 bytes each; the languages whose limits are sent to all tasks, and the salts that
#: spread more of them.
COMMON, LANGUAGES, SALTS = 1 << 20, 10_000, 64
BROADCAST_IDS = 2_000_000
LOW, HIGH, LEAST_TRUSTED = 0.01, 0.99, 50
_MERGE = 1 << 21
_UNIFORM = float(np.log(1 / 256))
#: A key is the number of a model and the bytes of an n-gram.
_BITS = 8 * ORDER


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, as a whole number, and the offsets of the texts. A text begins after line
    feeds."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    pad = ORDER - 1
    place = np.arange(len(data)) + np.repeat(np.arange(1, len(texts) + 1) * pad, np.diff(offsets))
    padded = np.full(len(data) + pad * len(texts), 10, np.uint8)
    padded[place] = data
    out = np.zeros(len(data), np.uint64)
    for back in range(pad, -1, -1):
        out = (out << np.uint64(8)) | padded[place - back]
    return out, offsets


def _counted(docs: DataFrame) -> DataFrame:
    """(model, gram, n) of (model, text), with the n-grams of ORDER bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)

        def out(found: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((found >> np.uint64(_BITS)).astype(np.int64)), pa.array((found & np.uint64((1 << _BITS) - 1)).view(np.int64)), pa.array(n)], ["model", "gram", "n"])

        for batch in batches:
            for part in parts(batch, 1):
                found, n = np.unique(_keys(part.column(0), part.column(1))[0], return_counts=True)
                keys.append(found)
                counts.append(n)
                size += len(found)
                if size > _MERGE:
                    found, n = merged()
                    if len(found) > _MERGE // 2:  # too many to hold: Spark adds up the rest
                        yield out(found, n)
                        found, n = found[:0], n[:0]
                    keys, counts, size = [found], [n], len(found)
        if keys:
            yield out(*merged())

    return docs.select("model", "text").mapInArrow(run, "model long, gram long, n long").groupBy("model", "gram").agg(F.sum("n").alias("n"))


def _keys(models: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The key of the n-gram that ends at each byte, and the offsets of the texts."""
    grams, offsets = codes(texts)
    return grams | np.repeat(models.to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(_BITS), np.diff(offsets)), offsets


def _discounts(counts: DataFrame) -> DataFrame:
    """(model, d1, d2, d3): of counts 1, 2 and 3 or more."""
    n = counts.groupBy("model").agg(*(F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    discount = lambda k: F.when(F.col("n1") == 0, 0.0).when(F.col(f"n{k}") == 0, k / 2).otherwise(F.least(F.lit(float(k)), F.greatest(F.lit(0.0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).alias(f"d{k}")
    return n.select("model", *(discount(k) for k in (1, 2, 3)))


def train(trusted: DataFrame) -> DataFrame:
    """(order, model, gram, n, p, back) of trusted (model, text): count and log probability of each n-gram seen, or with p
    null the log weight of a context of n - 1 bytes."""
    levels = {ORDER: durable(_counted(trusted), "grams")}
    for order in range(ORDER - 1, 0, -1):
        shorter = levels[order + 1].select("model", F.col("gram").bitwiseAND((1 << (8 * order)) - 1).alias("gram"))
        levels[order] = durable(shorter.groupBy("model", "gram").agg(F.count("*").alias("n")), "grams")
    model, below = None, None
    for order in range(1, ORDER + 1):
        # One row a fold.
        rows = levels[order].join(F.broadcast(_discounts(levels[order])), "model")
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.select("model", "gram", F.shiftright("gram", 8).alias("context"), "n", less.alias("d"))
        context = rows.groupBy("model", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("freed"))
        weighed = rows.join(context, ["model", "context"]).select("model", "gram", "n", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"), (F.col("freed") / F.col("total")).alias("gamma"))
        if below is None:
            weighed = weighed.withColumn("q", F.lit(1 / 256))
        else:
            weighed = weighed.withColumn("suffix", F.col("gram").bitwiseAND((1 << (8 * (order - 1))) - 1)).join(below, ["model", "suffix"])
        seen = durable(weighed.select("model", "gram", "n", (F.col("own") + F.col("gamma") * F.col("q")).alias("p")), "probabilities")
        below = seen.select("model", F.col("gram").alias("suffix"), F.col("p").alias("q"))
        backs = context.select(F.lit(order).alias("order"), "model", F.col("context").alias("gram"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("p"), F.log(F.greatest(F.col("freed") / F.col("total"), F.lit(1e-12))).alias("back"))
        both = seen.select(F.lit(order).alias("order"), "model", "gram", "n", F.log("p").alias("p"), F.lit(None).cast("double").alias("back")).unionByName(backs)
        model = both if model is None else model.unionByName(both)
    found = durable(model, "language-model")
    forget(*levels.values())
    return found


def _priced(keys: DataFrame, model: DataFrame) -> DataFrame:
    """(key, log_p) of different keys (key). Those not seen whole are looked up in all lower orders at once."""
    key = lambda c: F.shiftleft("model", _BITS).bitwiseOR(F.col(c))
    whole = model.filter((F.col("order") == ORDER) & F.col("p").isNotNull()).select(key("gram").alias("key"), "p")
    looked = keys.join(whole, "key", "left")
    number, gram = F.shiftrightunsigned("key", _BITS), F.col("key").bitwiseAND((1 << _BITS) - 1)
    of = lambda order: gram.bitwiseAND((1 << (8 * order)) - 1)
    wanted = [F.struct(F.lit(f"p{k}").alias("slot"), of(k).alias("gram")) for k in range(1, ORDER)] + [F.struct(F.lit(f"b{k}").alias("slot"), F.shiftright(of(k), 8).alias("gram")) for k in range(1, ORDER + 1)]
    asked = looked.filter("p IS NULL").select("key", number.alias("model"), F.explode(F.array(*wanted)).alias("x")).select("key", "model", "x.*")
    slots = model.select("model", "gram", F.concat(F.when(F.col("p").isNull(), "b").otherwise("p"), F.col("order").cast("string")).alias("slot"), F.coalesce("p", "back").alias("value"))
    found = asked.join(slots, ["model", "slot", "gram"], "left").groupBy("key").agg(*(F.max(F.when(F.col("slot") == s, F.col("value"))).alias(s) for s in [f"p{k}" for k in range(1, ORDER)] + [f"b{k}" for k in range(1, ORDER + 1)]))
    back = lambda k: F.coalesce(f"b{k}", F.lit(0.0))
    total = back(1) + _UNIFORM
    for k in range(2, ORDER + 1):
        total = back(k) + F.coalesce(F.col(f"p{k - 1}"), total)
    return looked.filter("p IS NOT NULL").select("key", F.col("p").alias("log_p")).unionByName(found.select("key", total.alias("log_p")))


def _common(model: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, in order, and log probabilities of the whole n-grams of the highest counts, `most` at most."""
    whole = model.filter((F.col("order") == ORDER) & F.col("p").isNotNull())
    sizes = whole.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect()  # 65,536 rows at most
    upto = np.cumsum([r.k for r in sizes])
    least = [r.n for r, k in zip(sizes, upto) if k <= most]
    found = whole.filter(F.col("n") >= (least[-1] if least else 1 << 62)).select(F.shiftleft("model", _BITS).bitwiseOR(F.col("gram")).alias("key"), "p").toArrow()  # `most` rows
    keys, p = found.column("key").to_numpy().astype(np.int64).view(np.uint64), found.column("p").to_numpy()
    order = np.argsort(keys)
    return keys[order], p[order]


def perplexities(docs: DataFrame, model: DataFrame, common: int = COMMON) -> DataFrame:
    """(id, lang, perplexity) of docs (id, lang, text, model); null where a text has no bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(model, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, log_p = shared.value
        for batch in batches:
            for part in parts(batch, 2):
                keys, offsets = _keys(part.column(3), part.column(2))
                found, at = np.unique(keys, return_inverse=True)
                place = np.minimum(np.searchsorted(held, found), max(len(held) - 1, 0))
                known = held[place] == found if len(held) else np.zeros(len(found), bool)
                value = np.where(known, log_p[place] if len(held) else 0.0, 0.0)
                upto = np.concatenate([[0.0], np.cumsum(value[at])])
                rest = np.flatnonzero(~known[at])
                row = np.searchsorted(offsets, rest, "right") - 1
                order = np.lexsort((at[rest], row))
                row, which = row[order], at[rest][order]
                head = firsts(row, which)
                count = np.diff(np.append(head, len(row)))
                lists = pa.array(np.searchsorted(row[head], np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(upto[offsets[1:]] - upto[offsets[:-1]]), pa.ListArray.from_arrays(lists, pa.array(found[which[head]].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(count.astype(np.int64)))],
                    ["id", "lang", "n_bytes", "log_p", "key", "n"],
                )

    partly = docs.select("id", "lang", "text", "model").mapInArrow(run, "id long, lang string, n_bytes long, log_p double, key array<long>, n array<long>")
    # Rows may share an id or have none, so they are told apart by a number of their own, written with them.
    partly = durable(partly.withColumn("uid", F.monotonically_increasing_id()), "partly-scored")
    rare = partly.filter("size(key) > 0").select("uid", F.explode(F.arrays_zip("key", "n")).alias("x")).select("uid", "x.*")
    priced = durable(_priced(rare.select("key").distinct(), model), "priced")
    rest = rare.join(priced, "key").groupBy("uid").agg(F.sum(F.col("n") * F.col("log_p")).alias("rest"))
    total = F.col("log_p") + F.coalesce("rest", F.lit(0.0))
    met = partly.drop("key", "n").join(rest, "uid", "left")
    return met.select("id", "lang", F.when(F.col("n_bytes") > 0, F.exp(-total / F.col("n_bytes"))).alias("perplexity"))


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, perplexity, kept) of every document; trusted: (id), the documents to learn from."""
    fold = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(FOLDS))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col(text_col).cast("string").alias("text"), fold.cast("long").alias("model"))
    ids = trusted.select(F.col(id_col).cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    # Two million ids of eight bytes at most are sent to all tasks; more are joined.
    seen = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    # The model of a fold learns from the texts of all others.
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(FOLDS - 1).cast("long")), lambda k: k != F.col("model"))
    model = train(seen.select(F.explode(others).alias("model"), "text"))
    scored = durable(perplexities(rows, model), "perplexities")
    forget(model)
    good = scored.filter("perplexity IS NOT NULL").join(ids, "id", "left_semi")
    quantiles = lambda *keys: good.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("perplexity", [LOW, HIGH], 10_000).alias("q"))
    every = quantiles().first()["q"] or [None, None]  # two numbers
    fences = quantiles("lang").filter(F.col("n") >= LEAST_TRUSTED).select("lang", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    low, high = (F.coalesce(c, F.lit(x).cast("double")) for c, x in zip(("low", "high"), every))
    inside = F.coalesce(F.col("perplexity").between(low, high), F.col("perplexity").isNotNull())
    if fences.count() <= LANGUAGES:
        met = scored.join(F.broadcast(fences), "lang", "left")
    else:
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
        met = scored.select("*", salt).join(fences.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "salt"], "left")
    return met.select(F.col("id").alias(id_col), "perplexity", inside.alias("kept"))
