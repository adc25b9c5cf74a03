"""Small files of other formats in and out: JSON, NPZ, CSV, YAML, text reports."""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def place(spark: SparkSession, path: str):
    """A path's file system and the path as Hadoop has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes one file, in any file system that Spark reaches, from the driver: for reports and single arrays."""
    fs, p = place(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def get_bytes(spark: SparkSession, path: str) -> bytes:
    """One file's bytes on the driver."""
    fs, p = place(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def plain(value: object) -> object:
    """numpy numbers, arrays and sets as what JSON can hold; other unknown things as text."""
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, np.ndarray):
        return value.tolist()
    return sorted(value) if isinstance(value, set | frozenset) else str(value)


def save_json(spark: SparkSession, value: object, path: str) -> None:
    put_bytes(spark, path, json.dumps(value, default=plain, indent=2).encode())


def load_json(spark: SparkSession, path: str) -> object:
    return json.loads(get_bytes(spark, path))


def save_npz(spark: SparkSession, array: np.ndarray, path: str, name: str = "arr") -> None:
    out = io.BytesIO()
    np.savez_compressed(out, **{name: array})
    put_bytes(spark, path, out.getvalue())


def read_npz(spark: SparkSession, path: str, name: str = "arr") -> DataFrame:
    """(path, shape, values) of every file that the path names: the array of that name, flat, as doubles; other files are an error."""

    def run(batches):
        for batch in batches:
            arrays = [np.load(io.BytesIO(c), allow_pickle=False)[name] for c in batch.column("content").to_pylist()]
            yield pa.record_batch([batch.column("path"), pa.array([list(a.shape) for a in arrays], pa.list_(pa.int32())), pa.array([a.ravel().astype(float) for a in arrays], pa.list_(pa.float64()))], names=["path", "shape", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, shape array<int>, values array<double>")


def load_config(spark: SparkSession, path: str) -> dict:
    """A configuration file as a dict: JSON, or YAML where that library is installed; an empty file is an empty dict."""
    data = get_bytes(spark, path)
    if path.endswith(".json"):
        return json.loads(data)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need the yaml library") from e
    return yaml.safe_load(data) or {}


def save_keypoints(keypoints: DataFrame, folder: str, kind: str = "normalized", descriptors: int = 0) -> None:
    """One CSV file with a header for each image below folder, in file=<name>_<kind>_keypoints, of rows (image_name, .., descriptor array): one column for each of so many descriptor bytes.

    An image's rows meet in one task first, so that no task adds a further file to the image's folder.
    """
    spread = [F.col("descriptor")[i].alias(f"descriptor_{i}") for i in range(descriptors)]
    rows = keypoints.select(*[c for c in keypoints.columns if c != "descriptor"], *spread)
    named = rows.withColumn("file", F.concat("image_name", F.lit(f"_{kind}_keypoints")))
    named.repartition("file").write.partitionBy("file").mode("overwrite").option("header", True).csv(folder)


def read_keypoints(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all files that `save_keypoints` wrote; a listing task takes many of their folders."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    # a task for each folder would cost more than the listing
    spark.conf.set(setting, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.option("header", True).csv(folder)
    finally:
        spark.conf.set(setting, before)


def save_clustered(spark: SparkSession, clustered: DataFrame, report: str, folder: str) -> None:
    """The clustered annotations as CSV files with a header and the report as report.txt, below folder."""
    clustered.write.mode("overwrite").option("header", True).csv(f"{folder}/clustered_annotations")
    put_bytes(spark, f"{folder}/report.txt", report.encode())
