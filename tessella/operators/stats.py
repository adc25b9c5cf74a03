"""Statistics and profiles of annotation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ids import running_sum


def categorical(df: DataFrame, prop: str, category: str) -> DataFrame:
    """Count per (category, value) and percentage of all rows of the category, rows without a value included in the whole."""
    total = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("_total"))
    count = df.where(F.col(prop).isNotNull() & F.col(category).isNotNull()).groupBy(category, prop).agg(F.count("*").alias("count"))
    return count.join(total, category).select(category, prop, "count", (F.col("count") * 100 / F.col("_total")).alias("percentage"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(*keys, q0, q1, ..): exact linear quantiles of the values that aren't null, for groups of any size.

    Equal values are counted first; the counts' running sum over ranges of (keys, value) tells each
    value's ranks, of which the wanted ones are picked. No task holds a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_sum(counts, [*keys, "_v"], "_n", "_first")
    groups = placed.groupBy(*keys).agg(F.min("_first").alias("_zero"), F.sum("_n").alias("_all"))
    on = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    named = groups.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_zero", "_all")
    ranked = placed.join(named, on).withColumn("_rank", F.col("_first") - F.col("_zero"))
    at = [F.lit(float(p)) * (F.col("_all") - 1) for p in shares]
    holds = lambda rank: (rank >= F.col("_rank")) & (rank < F.col("_rank") + F.col("_n"))
    ends = [(F.floor(x), F.ceil(x)) for x in at]
    some = ranked.where(reduce(Column.__or__, (holds(r) for e in ends for r in e)))
    picked = some.groupBy(*keys).agg(*[F.max(F.when(holds(r), F.col("_v"))).alias(f"_{i}{j}") for i, e in enumerate(ends) for j, r in enumerate(e)], *[F.max(x - F.floor(x)).alias(f"_f{i}") for i, x in enumerate(at)])
    return picked.select(*keys, *[(F.col(f"_{i}0") * (1 - F.col(f"_f{i}")) + F.col(f"_{i}1") * F.col(f"_f{i}")).alias(f"q{i}") for i in range(len(shares))])


def numerical(df: DataFrame, prop: str, category: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and linear quartiles per category over rows with both values."""
    v = F.col(prop).cast("double")
    known = df.dropna(subset=[prop, category]).select(category, v.alias("v"))
    out = known.groupBy(category).agg(F.count("*").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return out.join(quantiles(known, [category], "v", [0.25, 0.5, 0.75]).toDF(category, "p25", "p50", "p75"), category)


def shares_of_known(df: DataFrame, prop: str, category: str) -> DataFrame:
    """Count per (category, value) and its share of the category's rows that have a value."""
    count = df.dropna(subset=[prop, category]).groupBy(category, prop).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(category))
    return count.select(category, prop, "count", (F.col("count") * 100 / total).alias("percentage"))


def basics(df: DataFrame, category: str = "category_id", image: str = "image_id") -> DataFrame:
    out = df.agg(F.count("*").alias("annotations"), F.count_distinct(category).alias("categories"), F.count_distinct(image).alias("images"))
    return out.withColumn("per_image", F.try_divide(F.col("annotations"), F.col("images")))


def profile(df: DataFrame, numeric: list[str], categorical_: list[str]) -> DataFrame:
    """A row per property: filled and missing rows, and either numeric extremes or distinct values and the commonest (smallest on ties)."""
    n = F.count("*")
    parts = []
    for c in numeric:
        v = F.col(c).cast("double")
        parts.append(F.struct(F.lit(c).alias("property"), F.lit("numerical").alias("kind"), F.count(v).alias("filled"), (n - F.count(v)).alias("missing"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.lit(None).cast("bigint").alias("distinct_values"), F.lit(None).cast("string").alias("commonest")))
    for c in categorical_:
        v = F.col(c).cast("string")
        none = F.lit(None).cast("double")
        parts.append(F.struct(F.lit(c).alias("property"), F.lit("categorical").alias("kind"), F.count(v).alias("filled"), (n - F.count(v)).alias("missing"), none.alias("min"), none.alias("max"), none.alias("mean"), none.alias("std"), F.count_distinct(v).alias("distinct_values"), F.mode(v, True).alias("commonest")))
    rows = df.agg(n.alias("_n"), *[p.alias(f"_p{i}") for i, p in enumerate(parts)])
    out = rows.select("_n", F.explode(F.array(*[F.col(f"_p{i}") for i in range(len(parts))])).alias("p")).select("_n", "p.*")
    return out.withColumn("fill_rate", F.try_divide(F.col("filled") * 100, F.col("_n"))).drop("_n")


def breakdown(df: DataFrame, category: str = "category_name") -> DataFrame:
    out = df.groupBy(category).agg(F.count("*").alias("count"), F.avg("area").alias("mean_area"), F.avg(F.expr("IF(h > 0, w / h, 0D)")).alias("mean_aspect"))
    return out.withColumn("percentage", F.col("count") * 100 / F.sum("count").over(Window.partitionBy(F.lit(0))))


def histogram(df: DataFrame, prop: str, bins: int, by: str | None = None) -> DataFrame:
    """(by, bin, low, count): bins of equal width from least to largest value, the last one closed."""
    keys = [by] if by else []
    ends = df.where(F.col(prop).isNotNull()).groupBy(*keys).agg(F.min(prop).alias("_lo"), F.max(prop).alias("_hi"))
    rows = df.where(F.col(prop).isNotNull())
    rows = rows.join(F.broadcast(ends), by) if by else rows.crossJoin(F.broadcast(ends))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(prop) - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    return rows.groupBy(*keys, at.alias("bin"), (F.col("_lo") + at * width).alias("low")).agg(F.count("*").alias("count"))


def discover_properties(raw: DataFrame, column: str = "raw", position: str = "id", first: int = 100) -> DataFrame:
    """(property, kind, types): members of the first annotations' JSON, the kind by the first value seen. The limit is the operator's own."""
    head = raw.orderBy(position).limit(first).select(position, F.expr(f"parse_json({column})").alias("v"))
    members = head.select(position, F.explode(F.expr("map_entries(cast(v AS MAP<STRING, VARIANT>))")).alias("m")).selectExpr(position, "m.key AS property", "schema_of_variant(m.value) AS type")
    kind = "CASE WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t RLIKE '^(BIGINT|DOUBLE|DECIMAL)' THEN 'numerical' WHEN t = 'STRING' THEN 'categorical' WHEN t LIKE 'ARRAY%' THEN 'list' ELSE 'other' END"
    out = members.groupBy("property").agg(F.min_by("type", position).alias("t"), F.array_sort(F.collect_set("type")).alias("types"))
    return out.selectExpr("property", f"{kind} AS kind", "array_join(types, ',') AS types")


def heatmap(df: DataFrame, width: float = 20.0, height: float = 10.0, step: float = 0.5) -> DataFrame:
    """(bx, by, count): box centres on a fixed canvas; the last bins are closed, points outside go, empty bins are 0."""
    nx, ny = round(width / step), round(height / step)
    inside = df.where((F.col("cx") >= 0) & (F.col("cx") <= width) & (F.col("cy") >= 0) & (F.col("cy") <= height))
    bins = inside.select(F.least(F.floor(F.col("cx") / step), F.lit(nx - 1)).cast("int").alias("bx"), F.least(F.floor(F.col("cy") / step), F.lit(ny - 1)).cast("int").alias("by"))
    grid = df.sparkSession.range(nx * ny).selectExpr(f"CAST(id % {nx} AS INT) AS bx", f"CAST(id DIV {nx} AS INT) AS by")
    return grid.join(bins.groupBy("bx", "by").agg(F.count("*").alias("n")), ["bx", "by"], "left").select("bx", "by", F.coalesce("n", F.lit(0)).alias("count"))


def smoothed(grid: DataFrame, nx: int, ny: int, sigma: float) -> DataFrame:
    """Gaussian blur of (bx, by, count): reflected edges, kernel cut at four sigma, one pass for each axis."""
    from math import exp

    reach = int(4 * sigma + 0.5)
    weight = {k: exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)}
    total = sum(weight.values())
    kernel = grid.sparkSession.createDataFrame([(k, w / total) for k, w in weight.items()], "k int, weight double")

    def along(g: DataFrame, axis: str, n: int) -> DataFrame:
        # the value at i counts for all targets t = i + k, and for their mirror images
        spots = g.crossJoin(F.broadcast(kernel)).withColumn("t", F.explode(F.expr(f"filter(sequence(0, {n - 1}), t -> pmod(t + k, {2 * n}) = {axis} OR {2 * n} - 1 - pmod(t + k, {2 * n}) = {axis})")))
        other = "by" if axis == "bx" else "bx"
        return spots.groupBy(F.col("t").alias(axis), other).agg(F.sum(F.col("count") * F.col("weight")).alias("count"))

    return along(along(grid, "bx", nx), "by", ny).select("bx", "by", F.col("count").alias("density"))
