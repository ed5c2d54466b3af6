"""texts were searched again in every branch of the plan that read what was found."""

from threadlake.operators import fidelity, summaries

COLUMNS = "session_id long, message_index long, role string, content string"


def messages(spark):
    return spark.createDataFrame([(s, i, ["user", "assistant"][i % 2], f"We decided to use TABLE {i}. Fixed the loader!\n```py\nx = {i}\n```") for s in range(4) for i in range(12)], COLUMNS)


def kept_tables(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation")


def test_outputs_are_found_once(spark):
    m = messages(spark)
    outs = m.filter("message_index < 3").selectExpr("session_id", "concat('User: ', upper(content)) AS output", "cast(message_index AS string) AS tier")
    assert kept_tables(fidelity.fidelity(m, outs)) >= 4 and kept_tables(fidelity.lost_items(m, outs)) >= 3
    assert {r.semantic for r in fidelity.fidelity(m, outs.selectExpr("session_id", "upper(output) AS output", "tier")).collect()} == {r.semantic for r in fidelity.fidelity(m, outs.selectExpr("session_id", "lower(output) AS output", "tier")).collect()}


def test_summaries_are_found_once(spark):
    m = messages(spark)
    found = summaries.summaries(m)
    assert kept_tables(found) == 2
    scored = m.selectExpr("session_id", "message_index", "map('goals', 0.5D, 'decisions', 0.5D, 'bugs', 0.1D, 'context', 0.3D, 'questions', 0.2D) AS scores", "1D AS boost")
    got = summaries.scored_summaries(m, scored)
    assert kept_tables(got) >= 4 and got.filter("section = 'goal'").count() == 4
