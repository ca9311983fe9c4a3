"""Writes of tables by natural keys: merge, insert what is new, replace partitions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slatewise.operators.ingest import first_of
from slatewise.sources.kept import keep


def merged(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key; of several new rows of a key that of the last ``order``."""
    one = new.dropDuplicates(keys) if order is None else first_of(new, keys, F.desc(order)).drop(order)
    return old.join(one.select(*keys), keys, "left_anti").unionByName(one)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key ``old`` lacks, one per key."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def replace_partitions(df: DataFrame, path: str, by: str, touched: list | None = None) -> None:
    """Only the partitions that ``df`` has are written anew; the commit is atomic per job. Partitions of the values ``touched`` that it has no rows for go.

    A large partition is written by several tasks, small ones share one, so that a task's rows don't grow with the table."""
    df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    if touched:
        held = {r[0] for r in df.select(by).distinct().collect()}
        _drop_partitions(df.sparkSession, df.select(by).schema, path, by, [v for v in touched if v not in held])


def _in(by: str, values: list) -> Column:
    some = F.col(by).isin([v for v in values if v is not None])
    return some | F.col(by).isNull() if None in values else some


def _drop_partitions(spark: SparkSession, schema: StructType, path: str, by: str, values: list) -> None:
    """Delete the folders of partitions; a table's partitions are few enough to be listed."""
    if not values:
        return
    folders = spark.read.schema(schema).parquet(path).where(_in(by, values)).select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")).distinct().collect()
    for (folder,) in folders:
        p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def replace_keys(new: DataFrame, gone: DataFrame, path: str, keys: list[str], by: str) -> list:
    """``new`` in place of all rows of the table at ``path`` whose ``keys`` are among those of ``gone``, partitioned by ``by``. Returns the values of ``by`` of all partitions that changed.

    Partitions are found by the new rows and by the old rows of those keys, wherever these lie; they are read with the types
    of the new rows, merged and replaced. The merged rows are written beside the table first, since a job can't replace
    what it reads. Done again after a failure it gives the same table. One writer at a time."""
    spark = new.sparkSession
    if not exists(spark, path):
        replace_partitions(new, path, by)
        return [r[0] for r in new.select(by).distinct().collect()]
    table = spark.read.schema(new.schema).parquet(path)
    ids = gone.select(*keys).distinct()
    touched = [r[0] for r in new.select(by).union(table.join(ids, keys, "left_semi").select(by)).distinct().collect()]
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    table.where(_in(by, touched)).join(ids, keys, "left_anti").unionByName(new).write.parquet(staged)
    replace_partitions(spark.read.schema(new.schema).parquet(staged), path, by, touched)
    return touched


def upsert(new: DataFrame, path: str, keys: list[str], by: str, order: str | None = None) -> list:
    """Merge ``new`` into the table at ``path``, partitioned by ``by``; of several new rows of a key that of the last ``order`` counts. Also where a key's partition
    changes there is one row of it afterwards. See replace_keys."""
    one = new.dropDuplicates(keys) if order is None else first_of(new, keys, F.desc(order)).drop(order)
    return replace_keys(one, one, path, keys, by)


def replace_range(new: DataFrame, path: str, gone: Column, by: str) -> list:
    """Delete the rows of the table at ``path`` for which ``gone`` (a condition: a season, dates, a team) holds and put ``new`` in their place.
    Returns the values of ``by`` of the partitions that changed.

    Partitions that hold such rows, or get new ones, are read, filtered and replaced in one commit; all others keep their
    files. A condition on ``by`` reads no other partition. Where ``gone`` is null a row stays. One writer at a time."""
    spark = new.sparkSession
    if not exists(spark, path):
        replace_partitions(new, path, by)
        return [r[0] for r in new.select(by).distinct().collect()]
    table = spark.read.schema(new.schema).parquet(path)
    touched = [r[0] for r in new.select(by).union(table.where(gone).select(by)).distinct().collect()]
    if touched:
        staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
        table.where(_in(by, touched)).where(~F.coalesce(gone, F.lit(False))).unionByName(new).write.parquet(staged)
        replace_partitions(spark.read.schema(new.schema).parquet(staged), path, by, touched)
    return touched


def merge_where(new: DataFrame, path: str, keys: list[str], by: str, better: Column, changes: dict[str, Column], insert: bool = False) -> list:
    """Change stored rows that ``new`` betters. ``better`` and the columns of ``changes`` speak of ``old`` and ``new`` rows of one key, as
    F.col("old.status"); what isn't in ``changes`` stays. With ``insert`` rows of new keys come in as they are (all columns then).
    Returns the values of ``by`` of the partitions that changed.

    Only partitions with a changed row are rewritten, in one commit; where none is, no file changes. Of several new rows
    of a key one counts: those must not differ."""
    spark = new.sparkSession
    table = spark.read.parquet(path)
    one = new.dropDuplicates(keys)
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    changed = table.alias("old").join(one.alias("new"), on).where(F.coalesce(better, F.lit(False)))
    changed = changed.select(*[changes[c].cast(table.schema[c].dataType).alias(c) if c in changes else F.col(f"old.{c}").alias(c) for c in table.columns])
    if insert:
        changed = changed.unionByName(one.join(table.select(*keys), keys, "left_anti").select(*table.columns))
    changed = keep(changed, "changed")
    return [] if changed.isEmpty() else replace_keys(changed, changed, path, keys, by)


def append_run(path: str, run_id: str, summary: DataFrame, best: DataFrame) -> None:
    """A backtest's summary and its best results appended under its id; a run that is already there is written anew."""
    for name, df in (("runs", summary), ("results", best)):
        replace_partitions(df.withColumn("run_id", F.lit(run_id)), f"{path}/{name}", "run_id")


def best_results(done: DataFrame) -> DataFrame:
    """Per pattern the tested fold of the highest z, with a number for its grade. Numbers are fixed values."""
    number = F.create_map(*[F.lit(x) for g, n in (("A", 90), ("B", 75), ("C", 60), ("D", 45), ("F", 30)) for x in (g, n)])
    return first_of(done, ["combo", "outcome"], F.desc("z"), "test_season").withColumn("grade_score", F.try_element_at(number, F.col("grade")))
