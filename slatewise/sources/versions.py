"""Several tables under one folder that change together: a pointer names the folder of each table's rows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

POINTER = "_current.json"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def pointer(spark: SparkSession, path: str) -> dict:
    """{"version": number, "tables": {name: {"folder", "schema"}}} of what was committed last; version 0 without tables where nothing was."""
    at = f"{path}/{POINTER}"
    if not _fs(spark, at).exists(_path(spark, at)):
        return {"version": 0, "tables": {}}
    stream = _fs(spark, at).open(_path(spark, at))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, **tables: DataFrame) -> int:
    """Write ``tables`` and make them those of ``path``, all at once; tables that aren't named stay as they are. Returns the new version.

    Each goes to a folder that nobody reads yet; then one rename puts the new pointer in the old one's place. A crash
    before it leaves the old tables whole, and folders that vacuum removes. Plans that read the old version go on reading
    it. One writer at a time; on a store whose rename isn't atomic the pointer's is not either."""
    now, new = pointer(spark, path), uuid.uuid4().hex
    held = dict(now["tables"])
    for name, df in tables.items():
        folder = f"_data/{new}/{name}"
        df.write.parquet(f"{path}/{folder}")
        held[name] = {"folder": folder, "schema": df.schema.jsonValue()}
    text = json.dumps({"version": now["version"] + 1, "tables": held})
    draft = f"{path}/_draft-{new}.json"
    out = _fs(spark, draft).create(_path(spark, draft), True)
    out.write(bytearray(text.encode()))
    out.close()
    gateway = spark.sparkContext._gateway
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, draft).toUri(), spark._jsc.hadoopConfiguration())
    files.rename(_path(spark, draft), _path(spark, f"{path}/{POINTER}"), options)
    return now["version"] + 1


def read(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    """The tables ``names`` of one and the same version."""
    held = pointer(spark, path)["tables"]
    return [spark.read.schema(StructType.fromJson(held[n]["schema"])).parquet(f"{path}/{held[n]['folder']}") for n in names]


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete folders that the pointer doesn't name: of old versions and of commits that failed. For times when nobody reads or writes. Returns how many."""
    used = {t["folder"].split("/")[1] + "/" + t["folder"].split("/")[2] for t in pointer(spark, path)["tables"].values()}
    data, gone = f"{path}/_data", 0
    fs = _fs(spark, data)
    for version in fs.listStatus(_path(spark, data)) if fs.exists(_path(spark, data)) else []:
        for table in fs.listStatus(version.getPath()):
            if f"{version.getPath().getName()}/{table.getPath().getName()}" not in used:
                gone += bool(fs.delete(table.getPath(), True))
    return gone
