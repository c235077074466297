"""Shared pieces: intermediate tables, skew-safe grouping and column handling."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session below spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent on a local master (tests on one machine) is a folder made here;
    on a cluster that would be each executor's own disk, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/corpusloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made[path] = (spark, path)
    return path


def drop(*tables: DataFrame | str) -> None:
    """Delete intermediate tables that nothing will read again."""
    for table in tables:
        path = table if isinstance(table, str) else getattr(table, "_corpusloom_path", None)
        if path in _made:
            spark, _ = _made.pop(path)
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in list(_made.values()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended
            return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    return out


def unused(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _runs(key: pa.ChunkedArray | pa.Array) -> list[int]:
    import numpy as np

    values = key.to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]


#: A key with more than this part of all rows is hot; there can be no more such keys than this.
HOT = 1000


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, how: str = "inner") -> DataFrame:
    """rows joined with `keyed`, which has one row for each key with the number `n` of rows that have it.

    The hot keys, HOT rows at most, are broadcast, and their rows stay where they are; the others are dealt
    by key. how: inner or left.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    hot, cold = (keyed.where(x).drop(n) for x in (F.col(n) * HOT > total, F.col(n) * HOT <= total))
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


#: Rows and bytes after which outputs of groups go on as one batch.
BATCH_ROWS, BATCH_BYTES = 4096, 1 << 20


def release() -> None:
    """Give memory that a task no longer uses back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for mapInArrow, whose worker keeps no memory when the task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return run


_resident: list[tuple] = []


def resident(key: tuple, build: Callable[[], Any]) -> Any:
    """What `build` makes, kept for the next call with this key. A worker keeps one such thing for all operators."""
    if not _resident or _resident[0][0] != key:
        _resident.clear()
        _resident.append((key, build()))
    return _resident[0][1]


def _batched(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for part in parts:
        if part.num_rows:
            held.append(part)
            rows, size = rows + part.num_rows, size + part.nbytes
        if rows >= BATCH_ROWS or size >= BATCH_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def map_groups(df: DataFrame, key: str, fn: Callable[[pa.Table], list[pa.RecordBatch]], schema: str, partitions: int | None = None, at_once: int = 0) -> DataFrame:
    """Apply fn to the rows of each key, for many small groups.

    The long column `key` deals and sorts the rows; a partition streams through. One group is
    held at a time, or with `at_once` as many whole groups as have that many rows together (fn then
    gets several groups, in order). The caller bounds the group sizes (it splits large ones).
    """
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        last, rows = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(key_at)
            begin, cuts = 0, _runs(values)
            for a in cuts[:-1]:
                if values[a].as_py() == last and a == 0:
                    continue
                if rows + a - begin > 0 and rows + a - begin >= at_once:
                    held.append(batch.slice(begin, a - begin))
                    yield pa.Table.from_batches(held)
                    held, rows, begin = [], 0, a
            held.append(batch.slice(begin))
            rows, last = rows + batch.num_rows - begin, values[len(values) - 1].as_py()
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(part for group in groups(batches) for part in fn(group))

    key_at = df.columns.index(key)
    n = partitions or shuffle_partitions(df.sparkSession)
    return df.repartition(n, key).sortWithinPartitions(key).mapInArrow(tidy(run), schema)
