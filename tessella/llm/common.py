"""What the operators of this subpackage share: inputs, shared folders, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discarded, dropped, shared_folder, written  # noqa: F401

#: A-Z and the letters they become; everything else stays as it is.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z only.
LOWER_BYTES = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Python's bytes.split() cuts at exactly these: \x20 and \x09-\x0D.
ASCII_SPACE = " \t\n\x0b\f\r"

#: What this worker process keeps from task to task: of one operator at a time.
_kept: dict[Hashable, object] = {}


def kept[T](key: Hashable, make: Callable[[], T]) -> T:
    """What `make` gives, kept for later tasks of this worker process; what was kept for another key goes.

    Workers outlive stages, so that else each would hold the memory of all operators of a session.
    """
    if key not in _kept:
        released()
        _kept[key] = make()
    return _kept[key]


def released() -> None:
    """What this worker process kept for any operator goes; called by operators that keep nothing."""
    if _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names that no column of df has, whatever its case: those given, with underscores before them where they are taken."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


#: A key with this part of all rows or more is hot: at most so many keys are broadcast.
HOT_PARTS = 1_000


def joined(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, parts: int = HOT_PARTS) -> DataFrame:
    """rows with the columns of their group, for groups (*keys, n, ..) with their number of rows n, of `total` in all.

    The few groups with a considerable part of all rows meet theirs by a broadcast of at most
    `parts` rows, the others by their keys, so that no key gathers rows in one task.
    """
    least = max(2, total // parts)
    hot, cold = F.broadcast(groups.where(F.col("n") >= least)), groups.where(F.col("n") < least)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def plus(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def lower_az(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def rows_of(batches: Iterable[pa.RecordBatch], *columns: str, most_bytes: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Each batch in slices of about most_bytes, with the named columns as Python lists."""
    for batch in batches:
        n, at = batch.num_rows, 0
        step = max(1, min(n, int(n * most_bytes / max(batch.nbytes, 1)))) if n else 1
        while at < n:
            part = batch.slice(at, step)
            yield part, [part.column(c).to_pylist() for c in columns]
            at += step
