"""No join of rows that unfold is left to the planner, which sees the size of a compressed file."""

from lakeseek.llm import graph, line_dedup, simhash
from lakeseek.llm.simhash import near_dedup


def test_near_dedup_and_line_dedup_broadcast_nothing(spark, monkeypatch):
    """A small file of fingerprints is 35 keys and 2,081 near values each."""
    same = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{same} {i % 9}" if i % 3 else " ".join(f"x{i}_{j}" for j in range(40)) + f"\na\nb\nc{i % 2}") for i in range(120)], "doc_id bigint, text string")
    plans = []
    for module in (simhash, graph, line_dedup):

        def recorded(df, label, *by, write=module.materialise):
            plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
            return write(df, label, *by)

        monkeypatch.setattr(module, "materialise", recorded)
    kept = near_dedup(docs, hot=4)
    lines = line_dedup.line_dedup(docs)
    plans += [(name, df._jdf.queryExecution().executedPlan().toString()) for name, df in (("kept", kept), ("lines", lines))]
    assert {"blocks", "links", "large-star", "small-star", "line-windows"} <= {label for label, _ in plans}
    assert [label for label, plan in plans if "Broadcast" in plan] == []
    assert {r.doc_id for r in kept.collect()} > set(range(0, 120, 3)) and lines.count() == 120
