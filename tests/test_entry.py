import importlib
import os
import sys
import types

import pytest

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query_and_rest_stands_without_llm(monkeypatch):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    # As if the subpackage had been deleted.
    monkeypatch.setitem(sys.modules, "quillspan.llm", None)
    monkeypatch.setitem(sys.modules, "quillspan.llm.queries", None)
    alone = importlib.reload(entry)
    assert "p5_found" in alone.queries() and not any(n.startswith(("p1_", "p8_")) for n in alone.queries())
    monkeypatch.undo()
    assert isinstance(importlib.reload(entry), types.ModuleType)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["table_name", "ref_field", "reason", "month", "n_orphans"]
