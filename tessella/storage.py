"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only on a local master that names no spark.checkpoint.dir, as in tests on one machine.
_own_folder: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a cluster without that setting is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="tessella-"))
        base = _own_folder[0]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: it cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = path or shared_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes tables in the shared folder, whatever file system that is."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discarded(*tables: DataFrame) -> None:
    """Deletes tables that `written` returned; nothing may read them any more."""
    dropped(tables[0].sparkSession, *(t._written_at for t in tables))
