"""Copies told apart by row: repeated ids with other texts, copies without ids."""

from collections import Counter

from slatewise.llm import ngram_join


def test_one_of_each_tells_rows_apart(spark):
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    rows = [
        (3, text("a")), (7, text("a") + " more"), (7, text("alone")),  # 7 is a copy once and once a text of its own
        (1, text("b")), (13, text("b") + " more"), (13, text("c")), (20, text("c") + " x"), (21, text("c") + " y"),  # 13 goes with 1, and stands for 20 and 21
        (None, text("d")), (None, text("d")), (None, text("d") + " more"), (None, text("e")), (30, text("e") + " z"),  # copies without ids; with one
        (40, text("f")), (40, text("f") + " more"), (41, text("g")), (41, text("g")), (None, ""), (None, None), (50, ""), (50, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, (r.text or "")[:5].split("0")[0]) for r in ngram_join.one_of_each(docs).collect())
    want = [(3, "a"), (7, "alone"[:5]), (1, "b"), (13, "c"), (None, "d"), (30, "e"), (40, "f"), (41, "g"), (None, ""), (None, ""), (50, "")]
    assert got == Counter(want), got
