"""Helpers shared by the operators: scratch tables, binding of columns, worker caches."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII characters.
SPACE = "[\\x20\\x09-\\x0D]+"
#: bytes.translate table that lower-cases A-Z and leaves every other byte alone.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only a local session may lack that setting; it then gets a temporary folder, as one
    machine is all there is.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return process_cache("scratch:folder", lambda: "file://" + tempfile.mkdtemp(prefix="docframe-"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it.

    Cuts the lineage without holding executor memory; the files survive lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder's name in the shared folder; it is deleted when the driver ends."""
    path = f"{scratch_dir(spark)}/docframe/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot if more than one of so many rows has it, so there are at most as many hot keys.
HOT = 1000


def join_lookup(rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``lookup``, which has each key once; null keys match nothing.

    Hot keys of ``rows`` are looked up by a broadcast of their HOT entries at most; rows of other
    keys are shuffled, and none of these keys has more than one in HOT of them.  ``rows`` is read
    three times and should be a table.
    """
    least = rows.count() / HOT
    there = F.lit(True)
    for k in on:
        there = there & F.col(k).isNotNull()
    hot = rows.where(there).groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(*on)
    found = hot.collect()
    if not found:
        return rows.join(lookup, on, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema))
    few = F.broadcast(lookup.join(hot, on, "left_semi"))
    return rows.join(hot, on, "left_semi").join(few, on, how).unionByName(rows.join(hot, on, "left_anti").join(lookup, on, how))


#: Bytes of an Arrow batch sent to a worker: texts can be long, and a batch is held several times over.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches in this session, unless a smaller bound is set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(key)
    size = int(found.rstrip("b")) if re.fullmatch(r"\d+b?", found) else 0
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def literal_doubles(values: list[float]) -> Column:
    """A constant array<double> of any length as one literal of the plan."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def literal_longs(values: list[int]) -> Column:
    if not values:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def token_hash(token: Column) -> Column:
    """CRC-32 of a string's UTF-8 bytes, as a long."""
    return F.crc32(token.cast("binary"))


def process_cache(key: str, make: Callable):
    """One object per worker process, kept between tasks of an operator: its key is
    "operator:what".  A worker that turns to another operator lets go of the last one's."""
    store = sys.__dict__.setdefault("_docframe_cache", {})
    if key not in store:
        for other in [k for k in store if k.partition(":")[0] != key.partition(":")[0]]:
            del store[other]
        store[key] = make()
    return store[key]


def give_back() -> None:
    """Return freed memory of this process to the system, as far as its allocators can.

    They keep much of it, and workers live on between tasks and stages.
    """
    pa.default_memory_pool().release_unused()
    # glibc's; other C libraries lack it
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def crc_mod(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor
