"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words in every contract: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session of one process (master ``local``), as in tests, gets a folder of its own where
    the setting is absent. On a cluster that is an error: no folder could be known to be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


#: Rows to a file of tables of few rows, and of others.
FEW_ROWS, FILE_ROWS = 10_000, 50_000


def files_for(spark: SparkSession, rows: int) -> int:
    """Files in which so many narrow rows are written: one for FILE_ROWS, or fewer rows while cores are idle."""
    return max(1, -(-rows // FILE_ROWS), min(spark.sparkContext.defaultParallelism, -(-rows // FEW_ROWS)))


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors.

    Where about ``rows`` narrow rows are known to come, the last step runs in no more tasks than
    those need, so that shuffles of many partitions do not leave as many tiny files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    (df if rows is None else df.coalesce(files_for(spark, rows))).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by stored(), once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/lodestone/" in name:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(conf).delete(path, True)


def free(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The runs of characters other than SPACES, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


T = TypeVar("T")


def trimmed(results: Iterable[T]) -> Iterator[T]:
    """The results of a Python worker, batch by batch; after each, memory that was freed goes back to the system.

    Workers live on from task to task and otherwise keep what their largest batch took.
    """
    trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)
    for x in results:
        yield x
        del x
        pa.default_memory_pool().release_unused()
        trim(0)
