"""COCO documents in and out, file listings, metadata maps and configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import dropped, shared_folder
from .files import place

IMAGES = "array<struct<id: bigint, width: int, height: int, file_name: string, license: int, date_captured: string>>"
ANNOTATIONS = "array<struct<id: bigint, image_id: bigint, category_id: bigint, segmentation: array<array<double>>, area: double, bbox: array<double>, iscrowd: int, keypoints: array<double>>>"
CATEGORIES = "array<struct<id: bigint, name: string, supercategory: string>>"
#: Lower-case endings of image files.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif")


def read_coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, annotations and categories of one or more documents, each with pos, its place in the list; missing keys are empty lists.

    images with one id: the last one stays. Integer coordinates are read as doubles, custom
    members are in `extra` of annotations as variants.
    """
    raw = spark.read.option("wholetext", True).text(path)
    doc = raw.select(F.from_json("value", f"images {IMAGES}, annotations {ANNOTATIONS}, categories {CATEGORIES}").alias("d"), F.try_parse_json("value").alias("v"))

    def rows(name: str) -> DataFrame:
        return doc.select(F.posexplode(f"d.{name}").alias("pos", "r")).select("pos", "r.*")

    images = rows("images").groupBy("id").agg(F.max_by(F.struct("pos", "width", "height", "file_name", "license", "date_captured"), "pos").alias("r")).select("id", "r.*")
    extra = doc.select(F.posexplode(F.expr("CAST(variant_get(v, '$.annotations') AS ARRAY<VARIANT>)")).alias("pos", "extra"))
    annotations = rows("annotations").join(extra, "pos")
    return {"images": images, "annotations": annotations, "categories": rows("categories")}


def boxes(annotations: DataFrame) -> DataFrame:
    """Corner form of annotations that have a box."""
    return annotations.where("bbox IS NOT NULL").selectExpr("id", "image_id", "bbox[0] AS x0", "bbox[1] AS y0", "bbox[0] + bbox[2] AS x1", "bbox[1] + bbox[3] AS y1")


def of_images(annotations: DataFrame, ids: DataFrame) -> DataFrame:
    """Boxes of the listed images (image_id); the image stays a column."""
    return boxes(annotations.join(ids.select("image_id").distinct(), "image_id", "left_semi"))


def of_categories(annotations: DataFrame, ids: DataFrame) -> DataFrame:
    return annotations.join(ids.select("category_id").distinct(), "category_id", "left_semi")


def document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(document): one COCO document as JSON, for sets that fit in one value; `save_document` writes one of any size."""
    one = lambda t, n: t.agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in t.columns if c != "id"]))).alias(n))
    return one(images, "images").crossJoin(one(annotations, "annotations")).crossJoin(one(categories, "categories")).select(F.to_json(F.struct("images", "annotations", "categories")).alias("document"))


#: The lines before, between and after the records of a document that `save_document` writes.
_FRAME = ('{"images": [', '], "annotations": [', '], "categories": [', "]}")


def save_document(path: str, images: DataFrame, annotations: DataFrame, categories: DataFrame) -> None:
    """One COCO document as one JSON file, a record on each line, each list in order of id.

    Tasks write the sorted lines, which the driver's JVM then copies into the file as a stream.
    """
    spark = images.sparkSession
    fs, target = place(spark, path)
    out, copy = fs.create(target, True), spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    sep = ",\n"
    try:
        for head, t in zip(_FRAME, (images, annotations, categories), strict=False):
            out.write(bytearray(f"{head}\n".encode()))
            columns = ["id", *[c for c in t.columns if c != "id"]]
            folder = shared_folder(spark, "document-lines")
            t.select(*columns).orderBy(*columns).select(F.to_json(F.struct(*columns)).alias("value")).write.option("lineSep", sep).text(folder)
            lines_fs, lines = place(spark, folder)
            parts = sorted((f.getPath().getName(), f.getLen(), f.getPath()) for f in lines_fs.listStatus(lines) if f.getLen() and f.getPath().getName().startswith("part-"))
            for i, (_, size, part) in enumerate(parts):
                stream = lines_fs.open(part)
                try:
                    # the last record has no separator after it
                    copy.copyLarge(stream, out, 0, size - (len(sep) if i + 1 == len(parts) else 0))
                finally:
                    stream.close()
            out.write(bytearray(b"\n"))
            dropped(spark, folder)
        out.write(bytearray(f"{_FRAME[-1]}\n".encode()))
    finally:
        out.close()


def read_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, annotations and categories of a file that `save_document` wrote, read in blocks of lines by many tasks."""
    # a block's lines are one task's, in order
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")).alias("at"))
    at = {r["value"]: r["at"] for r in lines.where(F.col("value").isin(*_FRAME)).collect()}
    spot = lambda line: F.struct(F.lit(at[line].block).cast("long").alias("block"), F.lit(at[line].place).cast("long").alias("place"))

    def rows(k: int, kind: str) -> DataFrame:
        inside = lines.where((F.col("at") > spot(_FRAME[k])) & (F.col("at") < spot(_FRAME[k + 1])) & (F.col("value") != ""))
        return inside.select(F.from_json(F.regexp_replace("value", ",$", ""), kind.removeprefix("array<")[:-1]).alias("r")).select("r.*")

    return {"images": rows(0, IMAGES), "annotations": rows(1, ANNOTATIONS), "categories": rows(2, CATEGORIES)}


def write_by_resolution(images: DataFrame, annotations: DataFrame, path: str) -> None:
    """Tables images and annotations below path, in folders width=.../height=..."""
    images.write.partitionBy("width", "height").mode("overwrite").json(f"{path}/images")
    size = images.select(F.col("id").alias("image_id"), "width", "height")
    annotations.join(size, "image_id").write.partitionBy("width", "height").mode("overwrite").json(f"{path}/annotations")


def image_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, length) of image files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", "length")
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*EXTENSIONS))


def merged_metadata(rows: DataFrame) -> DataFrame:
    """metadata: maps exif, xmp and iptc as one, the later winning; empty IPTC values go, without XMP there is XMP_error."""
    iptc = F.map_filter(F.coalesce("iptc", F.expr("map()").cast("map<string,string>")), lambda _, v: v.isNotNull() & (v != ""))
    xmp = F.coalesce("xmp", F.create_map(F.lit("XMP_error"), F.lit("no XMP packet")))
    exif = F.coalesce("exif", F.expr("map()").cast("map<string,string>"))
    entries = F.concat(F.map_entries(F.map_filter(exif, lambda k, _: ~F.map_contains_key(xmp, k) & ~F.map_contains_key(iptc, k))), F.map_entries(F.map_filter(xmp, lambda k, _: ~F.map_contains_key(iptc, k))), F.map_entries(iptc))
    return rows.withColumn("metadata", F.map_from_entries(entries))


def xmp_attributes(content: str = "content") -> F.Column:
    """map<string,string> of the first rdf:Description's attributes in the bytes' XMP packet; null without one."""
    text = F.col(content).cast("string")
    packet = F.regexp_extract(text, r"(?s)(<x:xmpmeta.*?</x:xmpmeta>)", 1)
    head = F.regexp_extract(packet, r"(?s)<rdf:Description\b([^>]*)>", 1)
    names, values = F.regexp_extract_all(head, F.lit(r'([\w:.-]+)\s*=\s*"([^"]*)"'), 1), F.regexp_extract_all(head, F.lit(r'([\w:.-]+)\s*=\s*"([^"]*)"'), 2)
    return F.when(packet != "", F.map_from_arrays(names, values))


def clean_names(m: str = "metadata") -> F.Column:
    """Map keys without their prefix up to the last colon; of equal keys the last stays."""
    short = f"transform(map_entries({m}), e -> struct(element_at(split(e.key, ':'), -1) AS key, e.value AS value))"
    return F.expr(f"map_from_entries(filter({short}, (e, i) -> NOT exists(slice({short}, i + 2, size({m})), f -> f.key = e.key)))")


@dataclass(frozen=True)
class Options:
    """Settings with defaults; unknown names are left out when made from a dict."""

    tile_width: int = 640
    tile_height: int = 640
    max_iterations: int = 20
    epsilon: float = 1.19209290e-07
    canvas_width: float = 20.0
    canvas_height: float = 10.0
    bin_size: float = 0.5
    guide: str = "green"

    @classmethod
    def of(cls, values: dict | None) -> Options:
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (values or {}).items() if k in names})


def lookup(config: dict, *keys: str, default: object = None) -> object:
    """A nested member, or the default where a step is missing."""
    for k in keys:
        if not isinstance(config, dict) or k not in config:
            return default
        config = config[k]
    return config


def header_size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the first bytes of a PNG, GIF, BMP or JPEG file; None if it can't be read."""
    d = data or b""
    if d[:8] == b"\x89PNG\r\n\x1a\n" and len(d) >= 24:
        return int.from_bytes(d[16:20], "big"), int.from_bytes(d[20:24], "big")
    if d[:3] == b"GIF" and len(d) >= 10:
        return int.from_bytes(d[6:8], "little"), int.from_bytes(d[8:10], "little")
    if d[:2] == b"BM" and len(d) >= 26:
        return int.from_bytes(d[18:22], "little"), abs(int.from_bytes(d[22:26], "little", signed=True))
    at = 2
    while d[:2] == b"\xff\xd8" and at + 9 < len(d) and d[at] == 0xFF:
        if 0xC0 <= d[at + 1] <= 0xCF and d[at + 1] not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(d[at + 7 : at + 9], "big"), int.from_bytes(d[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(d[at + 2 : at + 4], "big")
    return None


def image_sizes(files: DataFrame) -> DataFrame:
    """Rows (path, content) to (path, width, height); null sizes for unreadable files."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = [header_size(c) or (None, None) for c in pdf.content]
            yield pd.DataFrame({"path": pdf.path, "width": pd.array([s[0] for s in sizes], "Int32"), "height": pd.array([s[1] for s in sizes], "Int32")})

    kind = T.StructType([T.StructField("path", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])
    return files.select("path", "content").mapInPandas(run, kind)


def move_plan(sizes: DataFrame, target: str) -> DataFrame:
    """(path, target, action): where each readable image would go by resolution; a second file of one name stays."""
    from pyspark.sql import Window

    name = F.regexp_extract("path", r"([^/]*)$", 1)
    to = F.concat(F.lit(target + "/"), F.col("width"), F.lit("x"), F.col("height"), F.lit("/"), name)
    out = sizes.withColumn("target", F.when(F.col("width").isNotNull(), to))
    first = F.row_number().over(Window.partitionBy("target").orderBy("path")) == 1
    return out.withColumn("action", F.when(F.col("target").isNull(), "unreadable").when(first, "move").otherwise("exists")).select("path", "target", "action")
