from pyspark.sql import functions as F
from threadlake.operators import handovers as H, merging, retrieval

S, M = "session_id long, title string, platform string", "session_id long, message_index long, role string, content string"
STORED, FILES = "session_id long, tier long, content string", "session_id long, path string, language string, size long, content string"


def given(spark):
    long = "y" * 700
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(["Build <it> & go", "```a```", long, "```b``` and ```c```", None, "", "end", "```d```", "x", "```e``````f```"])]
    s = spark.createDataFrame([(1, "T & 'q'", "p1"), (1, "T & 'q'", "p1"), (2, None, None), (None, "lost", "p")], S)
    return s, spark.createDataFrame([*rows, (None, 0, "user", "lost"), (7, 0, "user", "no such session")], M)


def texts(df):
    return {r.session_id: r.text for r in df.collect()}


def test_briefs(spark):
    got = texts(H.briefs(*given(spark)))
    assert set(got) == {1, 2}
    assert "Messages: 10\nCode blocks: 6\n" in got[1] and "## Original Goal\nBuild <it> & go\n" in got[1] and "(last 6 messages)\n**user:** \n\n**assistant:** \n\n**user:** end" in got[1]
    assert got[1].split("## Code Produced\n")[1].startswith("```a```\n\n```b```\n\n```c```\n\n```d```\n\n```e```\n\n## Continue")
    assert "# \n\nPlatform: \nMessages: 0\nCode blocks: 0\n\n## Original Goal\nUnknown" in got[2] and H.NO_CODE in got[2]


def test_summaries_fall_back_by_tier(spark):
    s, m = given(spark)
    stored = [(1, 1, "one"), (1, 2, "two b"), (1, 2, "two a"), (1, 3, "three"), (2, 2, None)]
    got = {r.session_id: (r.tier, r.text) for r in H.active_summaries(s, m, spark.createDataFrame(stored, STORED)).collect()}
    assert got[1] == (2, "two a") and got[2][0] == 0 and got[2][1].startswith("Session: \nPlatform: \nMessages: 0")


def test_prompts(spark):
    s, m = given(spark)
    none, files = spark.createDataFrame([], STORED), spark.createDataFrame([(1, "b.py", "python", 3, "x<1"), (1, "a.txt", None, None, None)], FILES)
    xml = texts(H.prompts(s, m, spark.createDataFrame([(1, 1, "is <b>\nnext")], STORED), files, False))
    assert "<session_title>T &amp; &#x27;q&#x27;</session_title>" in xml[1] and "<original>Build &lt;it&gt; &amp; go</original>\n    <current>" + "y" * 300 + "</current>" in xml[1]
    assert '    <file path="a.txt" language="text" size="0">\n\n    </file>\n    <file path="b.py" language="python" size="3">\nx<1\n    </file>' in xml[1]
    assert "<smart_summary>\n    is &lt;b&gt;\n    next\n  </smart_summary>" in xml[1] and "system_instructions" not in xml[1] + xml[2] and "project_files" not in xml[2]
    plain = texts(H.prompts(s, m, none, files.limit(0), True, "do it"))
    assert "## Current Task\n\ndo it\n\n## Code Context\n\n```a```" in plain[1] and plain[1].endswith("Focus on: do it") and "Smart Summary" not in plain[1] and "Project Files" not in plain[1]
    assert "## Original Goal\n\n_(no first user message)_\n\n## Current Task\n\ndo it\n\n## Recent Conversation\n\n\n\n## Instructions" in plain[2]
    assert H.prompts(s.limit(0), m, none, files, True).count() == 0


def test_templates_are_merged_by_target(spark):
    rows = spark.createDataFrame([(c, t) for c in ("<meta></meta> a </meta>", "bare", None) for t in ("claude", "gemini", "grok", None)], "c string, t string")
    got = {(r.c, r.t): r.x for r in rows.withColumn("x", H.merged(F.col("c"), F.col("t"), F.lit("N"), F.lit("*"), F.lit("l1\nl2"))).collect()}
    block = "  <prompt_engine>\n    <template_name>N</template_name>\n    <template_icon>*</template_icon>\n    <instructions>\n      l1\n      l2\n    </instructions>\n  </prompt_engine>"
    assert got["<meta></meta> a </meta>", "claude"] == f"<meta></meta>\n{block} a </meta>" and got["bare", "claude"] == block + "\n\nbare" and got[None, "claude"] == block + "\n\n"
    assert got["bare", "gemini"] == "[SYSTEM INSTRUCTIONS — N]\nl1\nl2\n---\nbare" and got["bare", "grok"] == got["bare", None] == "## System Instructions (* N)\n\nl1\nl2\n\n---\nbare"


def test_prompts_to_build_at_their_limits(spark):
    m = spark.createDataFrame([(1, 0, "user", "a" * 300_000), (2, 0, "user", "a" * 300_001), (3, 0, "user", "b" * 499), *[(4, i, "user", None) for i in range(10)], (None, 0, "user", "c")], M)
    built = spark.createDataFrame([(3, "old", 1), (3, "1:499:" + "b" * 200, 91), (4, "10:0:", 90)], "session_id long, signature string, at_s long")
    got = H.prompts_to_build(m, built, 100).groupBy("session_id").agg(F.countDistinct("target").alias("t"), F.max("tier").alias("tier"), F.count("*").alias("n"))
    assert {tuple(r) for r in got.collect()} == {(1, 6, 2, 12), (4, 6, 2, 12)}
    assert {tuple(r) for r in H.prompts_to_build(m, built.limit(0), 100).filter("session_id = 3").select("tier").distinct().collect()} == {(1,)}


def test_texts_of_the_best_chunks(spark):
    c = [(1, 1, "a", [1.0, 0.0]), (1, 2, "b", [1.0, 0.0]), (1, 3, "c", [0.5, 0.5]), (1, 4, None, [1.0, 0.0]), (1, 5, "e", None), (2, 6, "f", [1.0, 0.0]), (None, 7, "g", [1.0, 0.0])]
    chunks = spark.createDataFrame(c, "session_id long, chunk_id long, text string, embedding array<double>")
    queries = spark.createDataFrame([(10, 1, [1.0, 0.0]), (11, 1, [0.0, 1.0]), (12, 9, [1.0, 0.0]), (13, 1, None), (14, 2, [0.0, 0.0])], "query_id long, session_id long, vector array<double>")
    got = {r.query_id: (r.n, r.text) for r in retrieval.context_texts(chunks, queries, 2).collect()}
    assert got == {10: (2, "a\n\n---\n\nb"), 11: (2, "c\n\n---\n\na"), 14: (1, "f")}


def test_only_tombstones_that_a_user_set_count(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "session_id long")
    entries = spark.createDataFrame([(1, "user_deleted"), (1, "expired"), (2, None), (3, "expired"), (None, None)], "session_id long, reason string")
    assert sorted((r.session_id for r in merging.without_deleted(rows, entries).collect()), key=str) == [3, 3, None]
