"""Queries that apply the operator library to whole tables. Their oracles, written on their own from the same rules, are
in `operator_oracles`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadlake.functions import hashes, text as T
from threadlake.operators import chunking, limits, merging, retrieval
from threadlake.sources import captures, samples
from threadlake.sources.tables import table

PLATFORMS = ["chatgpt", "claude", "grok", "gemini", "deepseek", "perplexity"]
WORDS = ["the", "ing", "root", "schema", "the"]
MODEL = "small"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations and the authored dialogues."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_index"), "role", F.col("text").alias("content"))
    return rows.unionByName(samples.frame(spark, samples.MESSAGES, samples.MESSAGE_COLUMNS))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the text of the document of the same number; a bar in it stands for code."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("session_id"), F.expr("vec_id div 10").alias("message_index"), "embedding")
    return rows.join(texts, "chunk_id", "left").withColumn("has_code", F.coalesce(F.col("text").contains("|"), F.lit(False)))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose number is divisible by 100, as a search has it."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").cast("bigint").alias("session_id"), F.col("embedding").alias("vector"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    platform = F.element_at(F.array(*map(F.lit, PLATFORMS)), (F.col("page_id") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", platform.alias("platform"), "url", "html")
    extra = spark.createDataFrame(
        [(-1, "chatgpt", "https://Chat.example.com/c/ab-12?model=x&c=77", ""), (-2, "grok", "https://g.example.com/chat/zz9?rid=5&q=1", ""), (-3, "grok", "https://g.example.com/conversation/y?rid=5", ""),
         (-4, "gemini", "https://m.example.com/app/id7/?a=1#top", ""), (-5, "claude", "https://c.example.com/chat/q-1/", ""), (-6, "deepseek", "https://d.example.com/a/chat/s/k2", ""), (-7, "claude", "no address", "")],
        "page_id long, platform string, url string, html string",
    )
    return rows.unionByName(extra)


def snapshots(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """One capture of every conversation, and of the authored sessions."""
    rows = captures.stored(spark, sf_dir) if source == "stored" else captures.incoming(spark, sf_dir)
    return rows.drop("message_id").unionByName(samples.frame(spark, samples.SNAPSHOTS, samples.SNAPSHOT_COLUMNS).filter(F.col("source") == source)).drop("source")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


# -- text and chunks


def chunked_messages(spark, sf_dir):
    return chunking.chunk_messages(messages(spark, sf_dir))


def code_blocks(spark, sf_dir):
    rows = chunking.message_parts(messages(spark, sf_dir).filter("content <> ''")).filter("is_code")
    return rows.select("session_id", "message_index", "part_index", F.coalesce("language", F.lit("")).alias("language"), T.code_language(F.col("text")).alias("guessed"), F.length("text").cast("bigint").alias("size"))


def message_hashes(spark, sf_dir):
    rows = messages(spark, sf_dir)
    c = F.coalesce("content", F.lit(""))
    head = F.concat("role", F.lit(":"), F.substring(c, 1, 100))
    tail = F.concat("role", F.length(c).cast("string"), F.right(c, F.lit(20)))
    return rows.select("session_id", "message_index", hashes.djb2(head).alias("head_hash"), hashes.djb2_signed(tail).alias("tail_hash"), hashes.djb2_xor(head).alias("xor_hash"))


def session_hashes(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumn("line", F.concat("role", F.lit(":"), F.substring(F.coalesce("content", F.lit("")), 1, 100)))
    joined = rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_index", "line"))), lambda x: x["line"]), "|").alias("s"))
    return joined.select("session_id", hashes.djb2(F.col("s")).alias("hash"))


def url_keys(spark, sf_dir):
    url, platform = F.col("url"), F.col("platform")
    path = F.regexp_replace(url, "^https?://|#.*$", "")
    return pages(spark, sf_dir).select("page_id", T.url_key(platform, url).alias("url_key"), F.coalesce(T.native_id(platform, url), F.lit("")).alias("native_id"), F.concat(platform, F.lit("-"), hashes.times31(path)).alias("legacy_id"))


def sanitised_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.sanitised(F.col("html")).alias("html"))


def sanitised_messages(spark, sf_dir):
    c = F.coalesce("content", F.lit(""))
    return messages(spark, sf_dir).select("session_id", "message_index", T.sanitised(c).alias("safe"), T.scrubbed(c).alias("scrubbed"), T.xml_text(c).alias("xml"), T.xml_attribute(c).alias("attribute"), T.cdata(c).alias("cdata"), T.slug(c).alias("slug"))


def message_predicates(spark, sf_dir):
    c = F.coalesce("content", F.lit(""))
    return messages(spark, sf_dir).select(
        "session_id", "message_index", T.is_acknowledgement(c).alias("acknowledgement"), T.has_error(c).alias("error"), T.is_prompt(c).alias("prompt"), T.is_meta_discussion(c).alias("meta"),
        T.without_fluff(c).alias("request"), F.round(T.weighed(c, T.DECISION_SCORES), 6).alias("decision"), F.round(T.weighed(c, T.BUG_SCORES), 6).alias("bug"), T.fingerprint(F.col("role"), c).alias("fingerprint"),
    )


def file_chunk_sizes(spark, sf_dir):
    cut = chunking.file_chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text"))
    return cut.select("file_id", "chunk_index", F.length("text").cast("bigint").alias("size"), F.md5("text").alias("md5"))


def sampled_chunks(spark, sf_dir):
    n = chunks(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n"))
    return n.select("session_id", F.explode(chunking.sample_positions(F.col("n"), 20)).alias("place"))


# -- vectors


def best_per_session(spark, sf_dir, k: int = 5):
    """For each query vector the best chunk of each session, then the k best sessions."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("owner"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = retrieval.nearest(rows, vector_queries(spark, sf_dir), k)
    return found.select("query_id", F.col("owner").alias("session_id"), F.col("id").alias("chunk_id"), "score")


def nearest_chunks(spark, sf_dir, k: int = 10):
    """For each query vector the k nearest chunks."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("owner"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.nearest(rows, vector_queries(spark, sf_dir), k).select("query_id", F.col("id").alias("chunk_id"), "score")


def _spread(spark, sf_dir):
    """The vectors as chunks of 61 sessions."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 61).alias("session_id"), "embedding")


def searched_everywhere(spark, sf_dir):
    return retrieval.global_search(_spread(spark, sf_dir), vector_queries(spark, sf_dir), 10)


def searched_near_sessions(spark, sf_dir):
    return retrieval.global_search(_spread(spark, sf_dir), vector_queries(spark, sf_dir), 10, sessions=20)


def session_centroids(spark, sf_dir):
    found = retrieval.centroids(chunks(spark, sf_dir), "session_id")
    return found.select("session_id", "n", F.posexplode("centroid").alias("dimension", "x")).select("session_id", "n", "dimension", F.round("x", 6).alias("x"))


def message_centroids(spark, sf_dir):
    found = retrieval.centroids(chunks(spark, sf_dir), "session_id", "message_index")
    return found.select("session_id", "message_index", "n", F.posexplode("centroid").alias("dimension", "x")).withColumn("x", F.round("x", 6))


def retrieved_chunks(spark, sf_dir):
    return retrieval.retrieve(chunks(spark, sf_dir), vector_queries(spark, sf_dir))


def keyword_retrieved(spark, sf_dir):
    return retrieval.keyword_retrieve(chunks(spark, sf_dir).filter("text IS NOT NULL"), sorted(set(WORDS)))


def keyword_search(spark, sf_dir):
    return retrieval.keyword_search(chunks(spark, sf_dir).filter("text IS NOT NULL"), WORDS, 25)


def boosted_chunks(spark, sf_dir):
    rows = chunks(spark, sf_dir).select("session_id", "chunk_id", (F.pmod(F.col("chunk_id") * 37, F.lit(101)) / 100).alias("score"))
    return retrieval.boosted(rows, 0.7, "session_id", order="chunk_id")


def attention_chunks(spark, sf_dir):
    return retrieval.attention_map(chunks(spark, sf_dir), vector_queries(spark, sf_dir), "light")


def category_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    categories = rows.filter("vec_id < 5").select(F.col("vec_id").alias("category"), F.col("embedding").alias("vector"))
    return retrieval.category_scores(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), categories)


# -- keyed writes


def upserted_subscriptions(spark, sf_dir):
    o = orders(spark, sf_dir)
    old = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("created_at"))
    new = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), F.lit("renewed").alias("status"), F.timestamp_add("DAY", F.lit(9), "o_orderdate").alias("created_at"))
    return merging.upsert(old, new, ["id"], keep=("created_at",))


def _sizes(spark, sf_dir, source):
    return snapshots(spark, sf_dir, source).groupBy("session_id").agg(F.count("*").alias("n"))


def known_snapshots(spark, sf_dir):
    return merging.best_known(_sizes(spark, sf_dir, "stored"), _sizes(spark, sf_dir, "incoming"))


def accepted_snapshots(spark, sf_dir):
    taken = merging.accepted(_sizes(spark, sf_dir, "incoming"), _sizes(spark, sf_dir, "stored")).withColumn("rule", F.lit("shrink"))
    return taken.unionByName(merging.full_history(_sizes(spark, sf_dir, "incoming"), _sizes(spark, sf_dir, "stored")).withColumn("rule", F.lit("history")))


def merged_messages(spark, sf_dir):
    return merging.merge_partial(snapshots(spark, sf_dir, "stored"), snapshots(spark, sf_dir, "incoming"))


def better_sessions(spark, sf_dir):
    sides = [merging.session_ends(snapshots(spark, sf_dir, s), "updated_at", "name") for s in ("stored", "incoming")]
    return merging.pick_better(*sides)


def newest_templates(spark, sf_dir):
    o = orders(spark, sf_dir).select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderstatus").alias("status"))
    side = lambda s: o.filter(F.col("status") == s).groupBy("id").agg(F.max_by(F.struct("version", "updated_at"), F.struct("updated_at", "version")).alias("x")).select("id", "x.version", "x.updated_at")
    return merging.last_writer(side("O"), side("F"), "id")


#: Tables of a cascade, with the column that names the session.
CASCADE = {"conversations": "conv_id", "orders": "o_custkey", "embeddings": "vec_id", "events": "user_id", "documents": "doc_id", "labels": "doc_id", "pages": "page_id", "lineitem": "l_suppkey", "customer": "c_custkey"}


def cascade_deleted(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("session_id"))
    kept = merging.without({n: table(spark, sf_dir, n).select(F.col(c).alias("session_id")) for n, c in CASCADE.items()}, gone)
    counted = [t.groupBy("session_id").agg(F.count("*").alias("n")).withColumn("table_name", F.lit(n)) for n, t in kept.items()]
    return reduce(DataFrame.unionByName, counted)


def orphan_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).join(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chunk_id")).distinct(), "chunk_id", "left_anti").select("chunk_id", "session_id")


def newest_tombstones(spark, sf_dir):
    o = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("session_id"), "o_orderstatus").agg(F.max("o_orderdate").alias("deleted_at"))
    side = lambda s: o.filter(F.col("o_orderstatus") == s).drop("o_orderstatus")
    return merging.tombstones(side("O"), side("F"))


def first_sync(spark, sf_dir):
    local = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    remote = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"))
    seed, upload = merging.first_sync(local, remote)
    return seed.withColumn("action", F.lit("seed")).unionByName(upload.withColumn("action", F.lit("upload")))


def _manifest(spark, sf_dir):
    sessions = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("n"))
    return sessions.select("session_id", F.col("n").cast("string").alias("hash"), F.when(F.col("session_id") % 5 == 0, "large").otherwise(MODEL).alias("model"), (F.col("n") * 10).alias("chunk_count"), (F.col("session_id") % 3 != 0).alias("is_complete"))


def manifest_status(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"))
    return merging.manifest_status(_manifest(spark, sf_dir), chunks(spark, sf_dir), m).select("session_id", "is_complete")


def sessions_needing_index(spark, sf_dir):
    sessions = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").cast("string").alias("hash"))
    return merging.needs_indexing(sessions, _manifest(spark, sf_dir).filter("session_id % 7 <> 0"), chunks(spark, sf_dir), MODEL)


def counted_requests(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM").alias("month"), "event_type", F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return merging.admitted(e, 3, "user_id", "month", "event_type").select("id", "used", "allowed")


def usage_decisions(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("tier")).agg(F.count("*").alias("used"))
    limits_of = spark.createDataFrame([("click", 10), ("view", 20), ("purchase", 5)], "tier string, allowance long")
    return merging.usage_decision(u, limits_of)


# -- limits


def request_windows(spark, sf_dir):
    at = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), "ts")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), at.alias("at"), F.col("event_id").alias("id"))
    return limits.first_request_windows(e, 3, 86400)


def adaptive_timeouts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("value").alias("ms"), (F.col("user_id") % 4).alias("size"))
    found = limits.adaptive_timeouts(e, 15.0, 90.0)
    return found.select("id", F.round("timeout", 6).alias("timeout"))


NAMES = """chunked_messages code_blocks message_hashes session_hashes url_keys sanitised_pages sanitised_messages message_predicates
file_chunk_sizes sampled_chunks best_per_session nearest_chunks searched_everywhere searched_near_sessions session_centroids message_centroids retrieved_chunks keyword_retrieved
keyword_search boosted_chunks attention_chunks category_scores upserted_subscriptions known_snapshots accepted_snapshots
merged_messages better_sessions newest_templates cascade_deleted orphan_chunks newest_tombstones first_sync manifest_status
sessions_needing_index counted_requests usage_decisions request_windows adaptive_timeouts""".split()

QUERIES = {name: globals()[name] for name in NAMES}
