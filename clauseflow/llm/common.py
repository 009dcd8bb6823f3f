"""What the corpus operators share: batches of bounded size, scratch tables, size checks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows times bytes up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Bytes of a scratch table that a writing task holds until it writes them; Parquet's default is 128 MB.
ROW_GROUP = 16 << 20


def trim() -> None:
    """Gives memory that a Python worker has freed back to the machine: workers live on between tasks, and several share an executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


_LAST = [0.0]


def forget(spark: SparkSession, every: float = 5) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more; else they stay until the driver happens to collect. At
    most once in so many seconds."""
    if time.monotonic() - _LAST[0] < every:
        return
    _LAST[0] = time.monotonic()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in a local run, where that is unset, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="clauseflow-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there, and lost executors lose nothing.

    The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    hadoop.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    forget(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a scratch table that nothing reads any more."""
    spark = df.sparkSession
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(jsc.hadoopConfiguration()).delete(hadoop, True)


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its rows (already written, so that counting is cheap) fit the limit."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most `limit` bytes of text; a row that is longer is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size)
        lo = 0
        while lo < len(size):
            before = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
        del batch
        trim()


def col_of(df: DataFrame, name: str, kind: str) -> Column:
    """The first column of that name, cast; null of that kind where df has none."""
    for k, c in enumerate(df.columns):
        if c == name:
            plain = df if df.columns.count(name) == 1 else df.toDF(*[f"_{i}" for i in range(len(df.columns))])
            return F.col(name).cast(kind) if plain is df else F.col(f"_{k}").cast(kind)
    return F.lit(None).cast(kind)


def narrowed(df: DataFrame, **columns: str) -> DataFrame:
    """Just these columns with these types, whatever else df has. Of several columns with one name the first counts;
    a missing one is null."""
    names = list(df.columns)
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(
        *[(F.col(f"_{names.index(c)}") if c in names else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()]
    )


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that would clash with those an operator adds."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
