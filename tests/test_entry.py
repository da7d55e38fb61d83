import subprocess
import sys

from tests.conftest import ROOT


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["o_orderkey", "c_name", "n_name", "o_orderstatus", "o_orderpriority", "c_mktsegment", "o_totalprice", "o_orderdate"]
    assert 0 < df.count() <= 50
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_corpus_operators():
    """The other queries stay when the corpus operators are taken away."""
    code = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name == "strataline.llm" or name.startswith("strataline.llm."):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q = e.queries()
assert "faceted_listing" in q and "pipeline" not in q and not [k for k in q if k.startswith("op1_")], sorted(q)
assert set(e.oracle_sql()) <= set(q)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
