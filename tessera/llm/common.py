"""What the corpus operators share: durable tables, row packing, text columns."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a Java character class and as plain characters.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. On one machine a folder of our own does where none is named; on a
    cluster executors would write to their own disks, so it is an error there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return named


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is run inside sends at most so many rows at a time to Python: with whole texts, many fewer than usual."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and read it back.

    This cuts the lineage in a way that survives lost executors. The folder goes when the driver's JVM ends; until then
    it takes disk, so the codec is one that makes texts small.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path, compression="zstd")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def read_note(spark: SparkSession, path: str) -> str | None:
    """The text of a small file in any store that Spark reads, if there is one."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the file, then rename, so that no reader sees a part of it."""
    jvm = spark.sparkContext._jvm
    at, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(new, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(at, False)
    fs.rename(new, at)


#: What operators remember in a Python worker, by operator: how to forget it.
REMEMBERED: dict[str, Callable[[], object]] = {}


def lean(operator: str) -> None:
    """A Python worker serves one operator after the other: what the others remember goes, and memory that is free goes
    back to the system."""
    for name, forget in REMEMBERED.items():
        if name != operator:
            forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only one C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def packed(df: DataFrame) -> Column:
    """The whole input row as one struct, so that no name of ours can clash with one of its columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def text_of(column: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
