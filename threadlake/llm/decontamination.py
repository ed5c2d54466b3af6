"""Benchmark decontamination with a distributed positional inverted index; DataFrame functions only.

1. Every token of every document that is also a word of an item is counted: the terms' frequencies.
2. Each window of an item (`width` words, or the whole of a shorter item) is looked up by its RAREST rarest terms. The
   index stores the postings (term, document, position) of those terms, in a written table.
3. Postings are adjusted by the term's offset in the item. Lists that meet at one (document, item, shift) are
   intersected: an item's windows are candidates there if as many rare terms stand in their places as a window has.
4. Candidates are compared word by word with their document's words: the exact phrase matches. Proximity matches take
   the same postings and ask for terms within a span instead of in their places.

The terms of the items are broadcast while there are no more than BROADCAST_ROWS of them, else Spark joins them by
shuffle. Everything else is keyed by document, so a passage that a third of all documents hold spreads like they do.

Results: words are lower-cased from A to Z only; a null text or a null item id has none; repeated items count once; an
empty table of documents gives no rows and one of items no hits; rows are told apart by a 64-bit hash of id and text, so that
a null id has results like any other, one id may have several texts, and each row gets its own result (rows whose hashes
collide share candidates, which each text's words confirm or not); proximity leaves rows with a null id out; other columns
are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadlake.llm.rules import let
from threadlake.llm.storage import durable

RAREST = 3
BROADCAST_ROWS = 500_000
_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _NOT_WORD), "")


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _row(id_: Column, text: Column) -> Column:
    return F.xxhash64(id_, text)


def _bounded(small: DataFrame, n: int) -> DataFrame:
    return F.broadcast(small) if n <= BROADCAST_ROWS else small


def item_words(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, item, words) of the items with an id and a word; one id may have several texts, each with its key."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), _words(_lower(F.col(text_col).cast("string"))).alias("words"))
    rows = rows.filter("item IS NOT NULL AND size(words) > 0").distinct()
    return rows.select(F.sha1(F.concat_ws("\x01", F.size("words").cast("string"), "item", "words")).alias("key"), "item", "words")


def _tokens(docs: DataFrame) -> DataFrame:
    """(id, pos, term); terms in lower case, so that no spelling of an item's word is missed."""
    return docs.select("id", F.posexplode(_words(F.col("text"))).alias("pos", "w")).select("id", "pos", F.lower("w").alias("term"))


def slots(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(key, at, term): of each window of the items, the places of its rarest terms in docs."""
    spots = items.select("key", "words", F.posexplode("words").alias("at", "w")).withColumn("term", F.lower("w"))
    terms = spots.select("term").distinct()
    frequency = _tokens(docs).join(_bounded(terms, terms.count()), "term").groupBy("term").agg(F.count("*").alias("n"))
    known = spots.join(frequency, "term", "left").select("key", F.size("words").alias("size"), "at", "term", F.coalesce("n", F.lit(0)).alias("n"))
    windows = known.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - width + 1), F.greatest(F.lit(0), F.least("at", F.col("size") - width)))))
    first = F.row_number().over(Window.partitionBy("key", "start").orderBy("n", "term", "at"))
    return windows.withColumn("r", first).filter(F.col("r") <= RAREST).select("key", "at", "term").distinct()


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored postings (id, pos, term) of the terms given."""
    few = terms.select("term").distinct()
    return durable(_tokens(docs.filter("id IS NOT NULL")).join(_bounded(few, few.count()), "term").select("term", "id", "pos"), "postings")


def phrases(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """(id, size, hits) of docs (id, text), and row, the hash of both; size: number of words; hits: (start, n, item), the
    exact matches of item windows."""
    named = docs.select(F.col("id").alias("doc"), _row(F.col("id"), F.col("text")).alias("id"), "text")
    docs = named.select("id", "text")
    items = durable(items, "item-words")
    wanted = durable(slots(docs, items, width), "slots")
    n = wanted.count()
    postings = index(docs, wanted)
    # Lists that meet at one shift: a window needs all of its rarest terms there.
    met = postings.join(_bounded(wanted, n), "term").groupBy("id", "key", (F.col("pos") - F.col("at")).alias("shift")).agg(F.count("*").alias("met"))
    size = F.least(F.lit(width), F.size("words"))
    open_windows = met.join(_bounded(items, n), "key").filter(F.col("met") >= F.least(F.lit(RAREST), F.size("words")))
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - size), lambda o: F.col("shift") + o >= 0)
    open_windows = open_windows.select("id", "item", "shift", "words", size.alias("n"), starts.alias("starts"))
    windows = F.transform("starts", lambda o: F.struct((F.col("shift") + o).alias("start"), F.col("n").alias("n"), F.array_join(F.slice("words", o + 1, F.col("n")), " ").alias("t"), F.col("item").alias("item")))
    found = open_windows.select("id", windows.alias("c")).groupBy("id").agg(F.flatten(F.collect_list("c")).alias("c"))
    none = F.array().cast("array<struct<start:int,n:int,item:string>>")
    matched = lambda ws: F.filter("c", lambda c: _lower(F.array_join(F.slice(ws, c["start"] + 1, c["n"]), " ")) == c["t"])
    judged = let(_words(F.col("text")), lambda ws: F.struct(F.size(ws).alias("size"), F.when(F.col("c").isNull(), none).otherwise(F.transform(matched(ws), lambda c: c.dropFields("t"))).alias("hits")))
    rows = named.join(found, "id", "left").select(F.col("doc").alias("id"), F.col("id").alias("row"), judged.alias("j"))
    return rows.select("id", "row", "j.size", F.coalesce("j.hits", none).alias("hits"))


def proximity(docs: DataFrame, items: DataFrame, width: int = 10, span: int = 20, least: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item, start): places from which `least` different rare terms of an item stand within `span` words."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = durable(item_words(items, item_col), "item-words")
    wanted = durable(slots(rows, known, width).join(known, "key").select("item", "term").distinct(), "slots")
    placed = index(rows, wanted).join(_bounded(wanted, wanted.count()), "term")
    ahead = Window.partitionBy("id", "item").orderBy("pos").rangeBetween(0, span - 1)
    near = placed.withColumn("terms", F.size(F.collect_set("term").over(ahead))).filter(F.col("terms") >= least)
    return near.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("pos").alias("start"))


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) of every document; items: the sorted ids of items with matches."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = phrases(rows, item_words(items, item_col), width)
    places = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))
    # size(null) is -1 where a text is null
    return found.select(
        F.col("id").alias(id_col),
        F.greatest("size", F.lit(0)).cast("bigint").alias("n_words"),
        F.size(places).cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"]))).alias("items"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs without the rows whose text holds a window of an item, also where the id is null or has other texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    gone = phrases(rows, item_words(items, item_col), width).filter(F.size("hits") > 0).select(F.col("id").alias("_doc"), F.col("row").alias("_row")).distinct()
    same = docs[id_col].eqNullSafe(gone["_doc"]) & (_row(docs[id_col], docs[text_col].cast("string")) == gone["_row"])
    return docs.join(gone, same, "left_anti")
