"""What the operators share: the shared folder, written tables, words and hashes."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session has none (tests on one machine), a local folder is set.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = os.path.join(tempfile.gettempdir(), f"trellis-{spark.sparkContext.applicationId}")
        spark.sparkContext.setCheckpointDir(known)
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


#: Folders of the tables that are written, in order.
WRITTEN: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """`df` written as Parquet under the shared folder and read again: lineage ends
    here, and the rows outlive the executors that made them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written(); the tables that were written on the way are deleted."""
    first = len(WRITTEN)
    out = written(make())
    spark, gone = out.sparkSession, WRITTEN[first:-1]
    WRITTEN[first:-1] = []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in map(jvm.org.apache.hadoop.fs.Path, gone):
        path.getFileSystem(conf).delete(path, True)
    return out


#: Rows of a table of unique keys that may be broadcast, and copies of it where it may not.
BROADCAST_KEYS, COPIES = 500_000, 16


def joined(rows: DataFrame, keys: DataFrame, key: str, count: int, how: str = "inner") -> DataFrame:
    """`rows` joined to `keys`, a table of `count` rows with few of each key, by a column that
    many rows may share: a broadcast where `keys` is small, else a join by the key and a
    salt, so that no task gets all rows of a hot key. Null keys meet nothing."""
    if count <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys), key, how)
    copies = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if not dict(rows.dtypes)[c].startswith("map")]), F.lit(COPIES)).cast("int")
    return rows.withColumn("_salt", salt).join(copies, [key, "_salt"], how).drop("_salt")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@functools.lru_cache(1)
def lean() -> None:
    """Makes a Python worker give the memory of large arrays back when it frees them: it lives on
    beside other tasks and stages."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        mallopt = ctypes.CDLL(None).mallopt
        for option, value in ((-8, 1), (-3, 1 << 20), (-1, 1 << 20)):  # arenas, mapped blocks, trimming
            mallopt(option, value)
    except (OSError, AttributeError):  # another C library
        pass


def trim() -> None:
    """Gives a Python worker's free memory back."""
    lean()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: Rows of a batch that Spark sends to Python, and rows and bytes that an operator takes at once.
BATCH_ROWS, PIECE_ROWS, PIECE_BYTES = 1024, 2048, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of whole texts on their way to Python: a session with larger batches
    gets those of BATCH_ROWS rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches, those with many rows or bytes of one column of texts in several parts. A
    text is never cut."""
    lean()
    for b in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            n = min(PIECE_ROWS, max(1, int(np.searchsorted(ends, done + PIECE_BYTES, side="right")) - at))
            yield b.slice(at, n)
            at += n


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with state made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        f = make()
        for b in batches:
            if b.num_rows:
                yield f(b)
        trim()

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
