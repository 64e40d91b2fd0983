"""The second side of a comparison is dealt by size, not into a fixed number of parts."""

from qaforge.operators import tablediff as TD
from qaforge.queries import table_queries as TQ


def test_same_tables_are_dealt_by_size(spark, monkeypatch):
    lines = spark.createDataFrame([(i // 3, i) for i in range(300)], "l_orderkey long, l_linenumber int")
    seen = []

    def watched(t1, t2, key):
        seen.append(t2._jdf.queryExecution().optimizedPlan().toString())
        return real(t1, t2, key)

    real = TD.changed_rows
    monkeypatch.setattr(TQ, "table", lambda *_: lines)
    monkeypatch.setattr(TD, "changed_rows", watched)
    row = TQ.diff_changed_rows_same(spark, "").first()
    assert (row.left_rows, row.right_rows, row.n_rows) == (0, 0, 300)
    assert "RebalancePartitions" in seen[0]
