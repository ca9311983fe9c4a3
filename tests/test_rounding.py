"""Rounding as the SQL does, also where the decimals of a mean end in a half."""

import duckdb
from pyspark.sql import functions as F

from slatewise.plans.queries import rounded


def test_halves(spark):
    pairs = [(10561, 640), (10301, 640), (-10561, 640), (1, 128), (5, 1280), (None, 640), (7, 3), *((k, n) for n in (640, 1280, 3200) for k in range(100 * n, 100 * n + n, 7))]
    con = duckdb.connect()
    con.execute("create table t (i int, a int, b int)")
    con.executemany("insert into t values (?, ?, ?)", [(i, *p) for i, p in enumerate(pairs)])
    want = [r[0] for r in con.execute("select round(a / b, 6) from t order by i").fetchall()]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a int, b int").orderBy("i")
    got = [r[0] for r in rows.select(rounded(F.col("a") / F.col("b"), 6)).collect()]
    assert got == want
    assert [r[0] for r in rows.select(F.round(F.col("a") / F.col("b"), 6)).collect()] != want
