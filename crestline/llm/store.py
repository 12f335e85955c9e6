"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, functions as F

_KEY = "spark.checkpoint.dir"
#: Tables that were made and not dropped.
_live: list[str] = []
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own where it is unset, on a single machine only."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} is not set: it must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="crestline-")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are dropped when it ends."""
    before = spark.conf.get(_CLEAN, None)  # None where it is not set, whatever its default
    try:
        spark.conf.set(_CLEAN, "true")
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def collected(df: DataFrame) -> pa.Table:
    """A table of proven small size on the driver; the shuffle files behind it are dropped."""
    with _cleaned(df.sparkSession):
        return df.toArrow()


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again.

    The rows are then fixed (ids made from partition numbers cannot change when a task
    runs again), lineage ends here, and the shuffle files behind it are dropped.  The
    table goes when it is dropped, or when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/crestline/{name}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._crestline_path = path
    _live.append(path)
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables made by ``cut`` that no later read needs."""
    for t in tables:
        _remove(t.sparkSession, t._crestline_path)
        _live.remove(t._crestline_path)


@contextlib.contextmanager
def made_here(paths: list[str]) -> Iterator[None]:
    """Adds to ``paths`` the tables that are made inside and not dropped there."""
    before = set(_live)
    yield
    paths += [p for p in _live if p not in before]


def drop_unread(paths: list[str], df: DataFrame) -> list[str]:
    """Removes the tables at ``paths`` but for those that ``df`` reads, which are returned."""
    leaves, read = df._jdf.queryExecution().analyzed().collectLeaves(), ""
    for i in range(leaves.size()):
        with contextlib.suppress(Py4JError):  # a leaf that is not a table of files
            read += leaves.apply(i).relation().location().rootPaths().mkString("\n") + "\n"
    kept = [p for p in paths if p.rsplit("/", 1)[-1] in read]
    for p in paths:
        if p not in kept:
            _remove(df.sparkSession, p)
            _live.remove(p)
    return kept


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as tell it from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str, row: str = "row") -> DataFrame:
    """``df`` and a number of each row, written once.

    Numbers made from partitions are only good within one scan: a later scan of the same
    files can be split otherwise (after an executor is lost or added).  All that refers to
    rows by number must read them from this table.
    """
    return cut(df.select(F.monotonically_increasing_id().alias(row), "*"), name)
