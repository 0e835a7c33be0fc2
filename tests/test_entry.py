import importlib
import sys

import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_llm_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tessera.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tessera.llm", None)
    importlib.reload(entry)
    names = entry.queries()
    assert "bm25_topk" in names and "pipeline" not in names and not [n for n in names if n.startswith("op1")]


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["chunk_id", "source_id", "score", "marker", "preview"] and 0 < out.count() <= 20
