"""What a worker keeps for one operator goes when another's task begins."""

from slatewise.llm import common


def test_turns(monkeypatch):
    gone = []
    monkeypatch.setattr(common, "_kept", {})
    monkeypatch.setattr(common, "_turn", "")
    common.let_go("a", lambda: gone.append("a"))
    common.let_go("b", lambda: gone.append("b"))
    for name in ("a", "a", "b", "b", "c", "a"):
        common.take_turn(name)
        gone.append(f"<{name}")
    assert gone == ["b", "<a", "<a", "a", "<b", "<b", "a", "b", "<c", "b", "<a"]


def test_tasks_take_turns(spark):
    import pyarrow as pa

    def told(batches):
        from slatewise.llm import common

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([common._turn] * b.num_rows)], names=["t"])

    assert {r.t for r in common.in_arrow(spark.range(5), told, "t string").collect()} == {__name__}
