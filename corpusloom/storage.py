"""Tables in the folder that driver and executors share: cuts of a lineage, and stored tables that queries read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_stored: dict[tuple[str, str, str], tuple[tuple, DataFrame]] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may do without it, and gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusloom-tables-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_root(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `scratch` has written and nothing will read again."""
    for table in tables:
        if path := getattr(table, "_scratch_path", None):
            where = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stamp_of(spark: SparkSession, path: str) -> tuple:
    """What tells whether the files at a path are still the same: their names, sizes and times, in order."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [fs.getFileStatus(where)]
    if found[0].isDirectory():
        found = list(fs.listStatus(where))
    return tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in found))


def stored(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """The table that `build` makes of the files at `source`, written once for an application and read from then on.

    It is made anew when the files at the source change, or after `forget`. by: a column that parts its folders,
    so that a filter on it reads only theirs.
    """
    key, stamp = (spark.sparkContext.applicationId, name, source), stamp_of(spark, source)
    if key not in _stored or _stored[key][0] != stamp:
        path = f"{shared_root(spark)}/stored-{name}-{uuid.uuid4().hex}"
        table = build()
        out = table.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
        _stored[key] = (stamp, spark.read.schema(table.schema).parquet(path))
    return _stored[key][1]


def forget(source: str) -> None:
    """Stored tables of a source are made anew when they are next asked for."""
    for key in [k for k in _stored if k[2] == source]:
        del _stored[key]
