import sys

import __spark_entry__


def test_the_rest_stays_without_what_llm_needs(monkeypatch):
    whole = set(__spark_entry__.queries())
    for name in [n for n in sys.modules if n.startswith("threadlake.llm") or n in ("corpus_pipeline", "ahocorasick")]:
        monkeypatch.delitem(sys.modules, name)
    parent = sys.modules.get("threadlake")
    if parent is not None and hasattr(parent, "llm"):
        monkeypatch.delattr(parent, "llm")
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    left = set(__spark_entry__.queries())
    assert len(left) > 100 and not any(n.startswith("op") and n[2].isdigit() for n in left) and left <= whole
    assert set(__spark_entry__.oracle_sql()) <= left


def test_queries_and_oracles():
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found) and len(found) > 150
