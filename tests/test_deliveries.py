"""A month's deliveries of many games are several files, each with its own games."""

import json

from pyspark.sql import functions as F

from slatewise.plans import landing


def test_parts_are_files(spark, tmp_path):
    part = F.floor(F.col("id") / 40).alias("part")
    rows = spark.range(100).select(F.lit("1995-01").alias("month"), part, landing.item("id"))
    path = landing.dump(str(tmp_path / "parts"), rows)
    files = [[r["id"] for r in json.loads(f[0])] for f in spark.read.text(path, wholetext=True).collect()]
    assert sorted(map(len, files)) == [20, 40, 40] and sorted(i for f in files for i in f) == list(range(100))
    assert spark.read.text(landing.dump(str(tmp_path / "whole"), rows.drop("part")), wholetext=True).count() == 1
