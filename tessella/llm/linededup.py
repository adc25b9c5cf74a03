"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A run is a bucketed table (h1, h2, n_docs, n_rows, last_doc): fixed ranges of the hash, one sorted
file each, so that runs are merged and anti-joined range by range. Batches of documents arrive in
descending order of id. A batch's line hashes are anti-joined with the runs' settled lines (those
found in enough documents already, whose largest id can no longer change) and the rest is added as
a run of level 0; as soon as a level holds `fanout` runs they are merged into one run of the next
level. Dropping is one join of all line hashes with the runs, where the few hashes that hold a
considerable part of all rows are joined by broadcast and the others by their hash.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, dropped, lower_az, shared_folder, written

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 3, 2
#: A hash with this part of a batch's share of all rows is hot: so at most HOT_PARTS * batches of them can be broadcast.
HOT_PARTS = 1_000
_HASH = ["h1", "h2"]


class LineRuns:
    """The levelled runs in a folder of their own; `levels` maps a level to its runs' tables."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, hot_rows: int = 1 << 62):
        self.spark, self.min_docs, self.fanout, self.hot_rows = spark, min_docs, fanout, hot_rows
        self.folder, self.levels, self.made = shared_folder(spark, "line-runs"), {}, 0
        self.ranges, self.name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"line_run_{uuid.uuid4().hex}"

    def merged(self, runs: list[str] | None = None) -> DataFrame:
        """One row for each line hash of these runs, or of all."""
        runs = [r for level in self.levels.values() for r in level] if runs is None else runs
        rows = reduce(DataFrame.union, (self.spark.table(r) for r in runs))
        return rows.groupBy(*_HASH).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_rows").alias("n_rows"), F.max("last_doc").alias("last_doc"))

    def _put(self, rows: DataFrame, level: int) -> None:
        self.made += 1
        name = f"{self.name}_{self.made}"
        # dealt as the buckets are, so that a bucket is one file
        rows = rows.select(*_HASH, "n_docs", "n_rows", "last_doc").repartition(self.ranges, *_HASH)
        rows.write.bucketBy(self.ranges, *_HASH).sortBy(*_HASH).option("path", f"{self.folder}/level={level}/{name}").saveAsTable(name)
        self.levels.setdefault(level, []).append(name)

    def _drop(self, level: int, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
        dropped(self.spark, *(f"{self.folder}/level={level}/{name}" for name in names))

    def add(self, keys: DataFrame) -> None:
        """A batch (doc_id, h1, h2); none of its ids may exceed one of an earlier batch.

        Rows are counted per document first, so that a hash in very many rows is summed up from
        partial counts. Hot hashes stay even if settled, so that the runs know how many rows they have.
        """
        per_doc = keys.groupBy(*_HASH, "doc_id").agg(F.count("*").alias("n"))
        found = per_doc.groupBy(*_HASH).agg(F.count("doc_id").alias("n_docs"), F.sum("n").alias("n_rows"), F.max("doc_id").alias("last_doc"))
        if self.levels:
            settled = self.merged().where(F.col("n_docs") >= self.min_docs).select("h1", F.col("h2").alias("same"))
            known = (F.col("f.h1") == F.col("s.h1")) & (F.col("h2") == F.col("same")) & (F.col("n_rows") < self.hot_rows)
            found = found.alias("f").join(settled.alias("s"), known, "left_anti").select("f.*")
        self._put(found, 0)
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            runs = self.levels.pop(level)
            self._put(self.merged(runs), level + 1)
            self._drop(level, runs)
            level += 1


def line_keys(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, pos, h1, h2) of each line whose key has min_chars code points; th tells rows with one id apart."""
    lines = rows.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line"))
    key = lines.select("doc_id", "th", "pos", F.btrim("line", F.lit(ASCII_SPACE)).alias("line")).where(F.length("line") >= min_chars)
    key = key.withColumn("line", lower_az(F.col("line")))
    return key.select("doc_id", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The input's rows and columns with `text` without repeated lines, plus n_lines and n_dropped.

    A line's key is the line stripped of ASCII white space and lower-cased (A-Z). Keys of min_chars
    code points or more found in min_docs documents or more lose all their lines but those of the
    largest doc_id holding it. Null or empty text: one empty line. A null doc_id counts as no
    document and keeps no such line. Rows repeated with one id count as one document. Hashes
    have 128 bits. Columns named n_lines or n_dropped are replaced, all others stay whatever their
    names; no rows give none.
    """
    spark = docs.sparkSession
    # the input's columns stay within one, so that none of theirs meets a name of these steps
    rows = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("row"), "doc_id", "text")
    keys = written(line_keys(rows, min_chars), "line-keys")
    marks = keys.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5], 1000).alias("at")).first()
    hot_rows = max(2, marks.n // (HOT_PARTS * batches))
    runs = LineRuns(spark, min_docs, fanout, hot_rows)
    ends = sorted(set(marks.at or []) if batches > 1 else [], reverse=True)
    for low, high in zip([*ends, None], [None, *ends], strict=True):
        batch = keys if low is None else keys.where(F.col("doc_id") > low)
        if low is None:
            batch = keys.where(F.col("doc_id").isNull() | (F.lit(True) if high is None else F.col("doc_id") <= high))
        elif high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        runs.add(batch)
    found = runs.merged()
    hot = F.broadcast(found.where(F.col("n_rows") >= hot_rows).select(*_HASH, "n_docs", "last_doc"))
    repeated = F.col("n_docs") >= min_docs
    gone = keys.join(hot.where(repeated), _HASH).unionByName(keys.join(hot, _HASH, "left_anti").join(found.where(repeated & (F.col("n_rows") < hot_rows)).select(*_HASH, "n_docs", "last_doc"), _HASH))
    gone = gone.where("doc_id IS NULL OR doc_id < last_doc").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    told = rows.select("row", F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("own"))
    out = told.join(gone, F.expr("id <=> doc_id AND own = th"), "left")
    return _without(out, docs.columns)


def _without(joined: DataFrame, columns: list[str]) -> DataFrame:
    """Keeps the stretches of lines between dropped positions, so that the cost is that of the lines."""
    x = joined.select("row", F.col("text").alias("old"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"), F.coalesce("gone", F.expr("CAST(array() AS ARRAY<INT>)")).alias("gone"))
    kept = F.expr("array_join(flatten(zip_with(concat(array(-1), gone), concat(gone, array(size(lines))), (a, b) -> slice(lines, a + 2, b - a - 1))), '\n')")
    text = F.when(F.size("gone") == 0, F.coalesce("old", F.lit(""))).otherwise(kept).alias("text")
    same = [text if c == "text" else F.col("row").getField(c).alias(c) for c in columns if c.lower() not in ("n_lines", "n_dropped")]
    return x.select(*same, F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"))


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """The query's rows: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
