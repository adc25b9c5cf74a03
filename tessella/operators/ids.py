"""Ids of annotation datasets: checks, maps, remapping, merging, and Bloom-filter arithmetic."""

from __future__ import annotations

from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import written


def summary(**tables: DataFrame) -> DataFrame:
    """(name, count, distinct_ids, min_id, max_id, unique) per table."""
    one = lambda n, t: t.agg(F.count("*").alias("count"), F.count_distinct("id").alias("distinct_ids"), F.min("id").alias("min_id"), F.max("id").alias("max_id")).withColumn("name", F.lit(n))
    out = reduce(DataFrame.unionByName, (one(n, t) for n, t in tables.items()))
    return out.select("name", "count", "distinct_ids", "min_id", "max_id", (F.col("count") == F.col("distinct_ids")).alias("unique"))


def duplicates(df: DataFrame, column: str = "id") -> DataFrame:
    return df.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("count")).where("count > 1")


def name_map(df: DataFrame, position: str, name: str = "name") -> DataFrame:
    """(id, name): the last name by position for each id."""
    return df.groupBy("id").agg(F.max_by(name, position).alias(name))


def rewrite_refs(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Foreign keys by a map (old_id, new_id); others stay."""
    m = mapping.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
    return df.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def _placed(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows with _part, their range of the order, and _at, their place in it, from 0.

    The ranges are sampled and dealt once: rows are written with their place, and whatever follows
    reads that table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id's upper bits are the partition, its lower 33 bits the place in it
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "placed")
    return placed.withColumns({"_part": F.shiftright("_at", 33), "_at": F.expr("_at & 8589934591L")})


def _offsets(sizes: DataFrame) -> DataFrame:
    """(_part, _before) of (_part, _size): one row for each range, so that this window is small whatever the rows."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")))


def running_number(df: DataFrame, order: list[str], column: str) -> DataFrame:
    """Numbers rows from 1 in the given order without one task for all: range partitions, counts, offsets."""
    placed = _placed(df, order)
    sizes = placed.groupBy("_part").agg((F.max("_at") + 1).alias("_size"))
    return placed.join(_offsets(sizes), "_part").withColumn(column, F.col("_at") + F.col("_before") + 1).drop("_at", "_part", "_before")


def running_sum(df: DataFrame, order: list[str], value: str, column: str) -> DataFrame:
    """The sum of `value` over all earlier rows of the order, likewise; a range's own sums are one task each."""
    placed = _placed(df, order)
    sizes = placed.groupBy("_part").agg(F.sum(value).alias("_size"))
    earlier = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("_in", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    return within.join(_offsets(sizes), "_part").withColumn(column, F.col("_in") + F.col("_before")).drop("_at", "_part", "_in", "_before")


def add_rows(existing: DataFrame, incoming: DataFrame, position: str, remap: bool = True) -> tuple[DataFrame, DataFrame]:
    """Incoming rows (id, position, ...) with ids that collide, with existing ones or an earlier incoming one, replaced, and the map.

    New ids follow the largest id of either side, in order of position. remap=False: a collision is an error.
    """
    first = Window.partitionBy("id").orderBy(position)
    old = existing.select(F.col("id").alias("_id")).distinct()
    marked = incoming.withColumn("_nth", F.row_number().over(first)).join(old, F.col("id") == F.col("_id"), "left")
    marked = marked.withColumn("_hit", (F.col("_nth") > 1) | F.col("_id").isNotNull())
    if not remap:
        failed = marked.withColumn("id", F.when(F.col("_hit"), F.raise_error(F.concat(F.lit("id exists: "), F.col("id").cast("string")))).otherwise(F.col("id")))
        return failed.drop("_nth", "_id", "_hit"), incoming.select(F.col("id").alias("old_id"), F.col("id").alias("new_id")).limit(0)
    top = existing.select("id").union(incoming.select("id")).agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    hits = running_number(marked.where("_hit").select(F.col("id").alias("old_id"), position), [position], "_n")
    hits = hits.crossJoin(F.broadcast(top)).select("old_id", position, (F.col("_top") + F.col("_n")).alias("new_id"))
    out = marked.drop("_nth", "_id", "_hit").join(hits.select(F.col("old_id").alias("id"), position, "new_id"), ["id", position], "left")
    return out.withColumn("id", F.coalesce("new_id", "id")).drop("new_id"), hits


def merge(base: dict[str, DataFrame], extra: dict[str, DataFrame], position: str = "pos") -> dict[str, DataFrame]:
    """images, annotations and categories of two datasets as one; categories meet by name, ids that collide are remapped."""
    images, image_map = add_rows(base["images"], extra["images"], position)
    known = base["categories"].select(F.col("name"), F.col("id").alias("_have"))
    top = base["categories"].agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    named = extra["categories"].join(known, "name", "left")
    fresh = named.where("_have IS NULL").groupBy("name").agg(F.min(position).alias(position))
    fresh = running_number(fresh, [position], "_n").crossJoin(F.broadcast(top)).select("name", (F.col("_top") + F.col("_n")).alias("_new"))
    named = named.join(fresh, "name", "left").withColumn("new_id", F.coalesce("_have", "_new"))
    category_map = named.groupBy(F.col("id").alias("old_id")).agg(F.max_by("new_id", position).alias("new_id"))
    annotations, annotation_map = add_rows(base["annotations"], extra["annotations"], position)
    annotations = rewrite_refs(rewrite_refs(annotations, "image_id", image_map), "category_id", category_map)
    added = fresh.join(named.select("name", "supercategory", position), "name").groupBy("name").agg(F.first("_new").alias("id"), F.min_by("supercategory", position).alias("supercategory"))
    both = lambda k, new: base[k].unionByName(new.drop(position), allowMissingColumns=True)
    return {"images": both("images", images), "annotations": both("annotations", annotations), "categories": both("categories", added), "annotation_map": annotation_map, "image_map": image_map, "category_map": category_map}


def without_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return images.join(annotations.select(F.col("image_id").alias("_i")).distinct(), F.col("id") == F.col("_i"), "left_anti").select("id")


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and number of hashes for n items at false-positive rate p."""
    if n <= 0 or not 0 < p < 1:
        raise ValueError("capacity must be over 0 and the rate between 0 and 1")
    m = ceil(-n * log(p) / log(2) ** 2)
    return m, max(1, ceil(m / n * log(2)))


def bloom_capacity(items: DataFrame, least: int) -> int:
    """A filter's capacity for all the items: `least` while they fit, else their number, so that the rate holds."""
    return max(least, items.count())


def bloom_positions(item: Column, bits: int, hashes: int, double: bool = True) -> Column:
    """Bit places of an item: (h1 + i * h2) mod bits, or a hash of its own seed for each, from the engine's 64-bit hash."""
    if not double:
        return F.array(*[F.pmod(F.shiftright(F.xxhash64(F.lit(i), item), 1), F.lit(bits)) for i in range(hashes)])
    h1, h2 = F.xxhash64(item), F.xxhash64(F.lit(1), item)
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.shiftright(h1, 1) + i * F.shiftright(h2, 8), F.lit(bits)))


def bloom_build(items: DataFrame, column: str, capacity: int, rate: float = 0.001, double: bool = True) -> DataFrame:
    """(word, mask): the set bits, 64 a row; rows grow with the filter, not on the driver."""
    m, k = bloom_size(capacity, rate)
    at = items.select(F.explode(bloom_positions(F.col(column), m, k, double)).alias("p"))
    return at.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(p, 64) AS INT))")).alias("mask"))


def bloom_export(bitmap: DataFrame, path: str, capacity: int, items: int, rate: float = 0.001, double: bool = True) -> None:
    """Writes a filter's bits with its parameters, as one table whose rows all carry them."""
    about = {"capacity": F.lit(capacity).cast("long"), "rate": F.lit(rate), "double": F.lit(double), "items": F.lit(items).cast("long")}
    bitmap.select("word", "mask").withColumns(about).write.mode("overwrite").parquet(path)


def bloom_import(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The bits (word, mask) of an exported filter and its parameters capacity, rate, double and items; an empty filter has none."""
    table = spark.read.parquet(path)
    first = table.select("capacity", "rate", "double", "items").first()
    return table.select("word", "mask"), first.asDict() if first else {}


def bloom_stats(bitmap: DataFrame, capacity: int, items: int, rate: float = 0.001) -> DataFrame:
    m, k = bloom_size(capacity, rate)
    fill = F.coalesce(F.sum(F.bit_count("mask")), F.lit(0)) / m
    out = bitmap.agg(fill.alias("fill_ratio"))
    return out.select(F.lit(m).alias("bits"), F.lit(k).alias("hashes"), "fill_ratio", F.pow("fill_ratio", F.lit(k)).alias("actual_rate"), F.lit(items / capacity).alias("utilization"), F.lit(m / max(items, 1)).alias("bits_per_item"), F.lit(items >= 0.7 * capacity).alias("should_resize"))


def bloom_might_contain(items: DataFrame, column: str, bitmap: DataFrame, capacity: int, rate: float = 0.001, double: bool = True) -> DataFrame:
    """The items' rows plus might_exist: all their bits are set."""
    m, k = bloom_size(capacity, rate)
    one = items.withColumn("_row", F.monotonically_increasing_id())
    probe = one.select("_row", F.explode(bloom_positions(F.col(column), m, k, double)).alias("p")).withColumn("word", F.floor(F.col("p") / 64))
    hit = probe.join(bitmap, "word", "left").select("_row", (F.coalesce(F.col("mask").bitwiseAND(F.expr("shiftleft(1L, CAST(pmod(p, 64) AS INT))")), F.lit(0)) != 0).alias("set"))
    found = hit.groupBy("_row").agg(F.bool_and("set").alias("might_exist"))
    return one.join(found, "_row").drop("_row")
