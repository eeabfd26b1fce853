import importlib
import os
import sys

import pytest

SF = "/root/testdata/sf0.001"


def test_entry_without_the_optional_operators(monkeypatch):
    import __spark_entry__ as entry

    assert {"op1_token_output", "pipeline"} <= set(entry.queries()) or entry.llm is None
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name in ("corpus_pipeline", "tessera.llm"):
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.setitem(sys.modules, "tessera.llm.queries", None)

    class Absent:
        """Hides the optional modules as if their files were gone."""

        @staticmethod
        def find_spec(name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("tessera.llm"):
                raise ModuleNotFoundError(f"No module named '{name}'", name="corpus_pipeline" if name == "corpus_pipeline" else "tessera.llm")
            return None

    for name in ("corpus_pipeline", "tessera.llm", "tessera.llm.queries"):
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setattr(sys, "meta_path", [Absent, *sys.meta_path])
    again = importlib.reload(entry)
    assert again.llm is None and "threshold_sum" in again.queries() and not any(q.startswith("op") and q[2].isdigit() for q in again.queries())
    monkeypatch.undo()
    importlib.reload(entry)


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables are absent")
def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables are absent")
def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tessera.queries import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = lambda cols, got: sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in got)
    for name, query in QUERIES.items():
        if name not in ORACLE_SQL:
            continue
        df, want = query(spark, SF), db.sql(ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns), name
        assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall()), name
