import math
import random
import re

from threadlake.operators import fidelity as O

M = "session_id long, message_index long, role string, content string"
OUT = "session_id long, tier string, output string"
WORDS = ["We chose the parser.", "It requires version two.", "Fixed the broken loader today", "still need a careful review", "```a = 1```", "```b = 2```", "plain talk", "User: quoted line", "must not break", ""]


def alike(item, target):
    words = [w for w in re.split(r"\W+", item.lower(), flags=re.ASCII) if len(w) > 4]
    return not words or sum(w in target.lower() for w in words) / len(words) >= 0.6


def percent(found, of):
    return math.floor(found / of * 100 + 0.5)


def brute(session, output):
    """The five parts over one session in memory."""
    if not output.strip():
        return [0] * 5
    texts = [c or "" for _, c in session]
    lines = [line.startswith("User:") for line in output.split("\n") if line.startswith(("User:", "Assistant:"))]
    users = [r == "user" for r, _ in session]
    roles = percent(sum(a == b for a, b in zip(lines, users)), max(len(users), 1)) if lines else 50
    blocks = [b for t in texts for b in re.findall(r"```.*?```", t, flags=re.S)]
    there = set(re.findall(r"```.*?```", output, flags=re.S))
    code = percent(sum(b in there for b in blocks), len(blocks)) if blocks else 100
    units = [u.strip() for t in texts for u in re.split(r"[.!?\n]", t)]
    pick = lambda p: [u for u in units if len(u) > 15 and re.search(p, u)][:8]
    goal = next((c or "" for r, c in session if r == "user"), "")[:600]
    items = [x for x in [goal] if x] + pick(O.FACT) + pick(O.CHOICE)
    done = [t.split("\n")[0].strip() for (r, _), t in zip(session, texts) if r == "assistant" and re.search(O.DONE, t)]
    todo = [re.split(r"[.!?\n]", t)[0].strip() for t in texts if re.search(O.OPEN, t)]
    tasks = [x for x in done if len(x) > 10][:12] + [x for x in todo if len(x) > 10][:10]
    share = lambda xs: percent(sum(alike(x, output) for x in xs), len(xs)) if xs else 100
    chars = sum(map(len, texts))
    ratio = len(output) / chars if chars else 1
    return [roles, code, share(items), share(tasks), next((s for least, s in O.KEPT_STEPS if ratio >= least), 25)]


def test_fidelity_equals_a_walk_over_random_sessions(spark):
    rng = random.Random(5)
    text = lambda: rng.choice([" ".join(rng.choices(WORDS, k=rng.randint(1, 6))), "\n".join(rng.choices(WORDS, k=3)), None, ""])
    sessions = {s: [(rng.choice(["user", "assistant", "tool", None]), text()) for _ in range(rng.randint(1, 30))] for s in range(60)}
    told = lambda rows: "\n".join(("User: " if r == "user" else "Assistant: ") + (c or "") for r, c in rows)
    outputs = {(s, t): o for s, rows in sessions.items() for t, o in {"half": told(rows[::2]), "tail": told(rows[-3:]), "bare": " ".join(c or "" for _, c in rows[:4]), "none": " \n"}.items()}
    m = spark.createDataFrame([(s, i, r, c) for s, rows in sessions.items() for i, (r, c) in enumerate(rows)], M)
    o = spark.createDataFrame([(s, t, x) for (s, t), x in outputs.items()], OUT)
    got = {(r.session_id, r.tier): [r.roles, r.code, r.semantic, r.tasks, r.compression] for r in O.fidelity(m, o).collect()}
    assert got == {k: brute(sessions[k[0]], x) for k, x in outputs.items()}
    assert len({tuple(v) for v in got.values()}) > 30


def test_odd_outputs(spark):
    m = spark.createDataFrame([(1, 0, "user", "Keep the ```x = 1``` block"), (1, 1, "assistant", None), (None, 0, "user", "lost")], M).selectExpr("*", "1 AS key", "2 AS output")
    rows = [(1, "a", "User: Keep the ```x = 1``` block"), (1, "a", "User: Keep the ```x = 1``` block"), (1, "a", "other"), (1, None, None), (9, "a", "no such session"), (None, "a", "none")]
    got = sorted(((r.session_id, r.tier, r.roles, r.code, r.total, r.grade) for r in O.fidelity(m, spark.createDataFrame(rows, OUT)).collect()), key=str)
    assert got == sorted([(1, "a", 50, 100, 90, "Excellent"), (1, "a", 50, 0, 33, "Fail"), (1, None, 0, 0, 0, "Fail"), (9, "a", 50, 100, 90, "Excellent"), (None, "a", 50, 100, 90, "Excellent")], key=str)
    lost = {(r.section, r.text) for r in O.lost_items(m, spark.createDataFrame(rows, OUT)).collect()}
    assert lost == {("code", "```x = 1```"), ("goal", "Keep the ```x = 1``` block")}
    assert O.fidelity(m.limit(0), spark.createDataFrame([], OUT)).count() == 0


def test_signals_of_messages(spark):
    texts = ["TypeError: we decided to stop, the plan is ```x```", None, "", "plain", "Root cause found", "ok", "ok"]
    m = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)] + [(2, 0, "user", "x" * 100_000)], M)
    got = {(r.session_id, r.message_index): (r.score, r.top) for r in O.signal_scores(m, "keep the Plan").collect()}
    n = len(texts[0])
    assert got[1, 0][0] == round(0.30 + 0.25 + 0.15 + 0.15 + min(0.07, n / 8000) + 0.08 * 1 / 2, 9)
    assert got[2, 0] == (0.07, True) and sum(top for (s, _), (_, top) in got.items() if s == 1) == 5


def test_buckets_cut_borrow_and_break_ties_by_id(spark):
    rows = [(1, i, "message", "we decided", 0.5) for i in range(20)] + [(1, 100 + i, "code", "x", 0.9) for i in range(9)]
    rows += [(2, i, "message", "words", float(i)) for i in range(12)] + [(3, 1, "message", None, 1.0), (3, 2, "message", "", 1.0)]
    c = spark.createDataFrame(rows, "session_id long, chunk_id long, kind string, text string, score double")
    got = {}
    for r in sorted(O.bucketed(c).collect(), key=lambda r: r.place):
        got.setdefault((r.session_id, r.section), []).append(r.chunk_id)
    assert got == {
        (1, "decisions"): list(range(8)), (1, "code"): list(range(100, 108)), (1, "context"): [108, *range(8, 15)],
        (2, "decisions"): [11, 10, 9], (2, "context"): [8, 7, 6, 5, 4], (3, "context"): [1, 2],
    }


def test_recommendations_at_their_limits(spark):
    cols = "platform string, score double, code double, retention double, compression double"
    got = lambda rows: {(r.kind, r.platform, r.value) for r in O.recommendations(spark.createDataFrame(rows, cols)).collect()}
    assert got([]) == set()
    assert got([("a", 75.0, 18.0, 12.0, 7.0)] * 3 + [("b", 10.0, 17.0, 12.0, 7.0)]) == set()
    assert got([("a", 74.0, 17.0, 11.0, 6.0)] * 3) == {("retention", None, 11.0), ("code", None, 3.0), ("compression", None, 6.0), ("platform", "a", 74.0)}
    assert got([(None, 50.0, None, None, None)] * 2) == {("platform", None, 50.0)}
