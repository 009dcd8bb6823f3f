"""Sessions: building one for local work, and giving executors the package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: (setting, Spark's default, ours): batches to Python workers in bytes, rows of a batch read from Parquet.
SMALLER = [("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "2m"), ("spark.sql.parquet.columnarReaderBatchSize", "4096", "512")]


def compiled(spark: SparkSession) -> SparkSession:
    """Stages whose generated method the JVM would only interpret (over 8,000 bytes it compiles none) are run operator by operator instead, their
    expressions in small methods: the detectors' stages are of that size, and some 20 times slower when interpreted."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":  # the default
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # findings are partitioned by site; a join by site and more finds its rows there, so neither side is shuffled again
    if spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true":  # the default
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Python workers import the package from a zip that Spark distributes, wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(path)
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default; a batch of that many documents is tens of MB
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        # what a worker derives from a batch follows its bytes, and so do the JVM's vectors of a batch read from Parquet
        for name, default, ours in SMALLER:
            if spark.conf.get(name) == default:
                spark.conf.set(name, ours)
        _SHIPPED.add(sc.applicationId)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; on a cluster spark-submit's settings rule."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
