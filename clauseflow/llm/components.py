"""Connected components of an edge table: spanning forests of its partitions, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, trim

#: Edges that one task finishes by itself (16 bytes each); more than that take the distributed steps.
FEW = 2_000_000


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to the least node of each component within the partition's pairs: no more than it has nodes."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[pa.RecordBatch] = []

    def reduced(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v = at[: len(a)], at[len(a) :]
        label = np.arange(len(names))
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[v], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        own = label != np.arange(len(names))
        return names[own], names[label[own]]

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) > 1_000_000:
            a, b = reduced(*(np.concatenate([x, *(h.column(k).to_numpy() for h in held)]) for x, k in ((a, "a"), (b, "b"))))
            held = []
    a, b = reduced(*(np.concatenate([x, *(h.column(k).to_numpy() for h in held)]) for x, k in ((a, "a"), (b, "b"))))
    trim()
    yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """(node, component): the component is its least node. Nodes without an edge don't appear.

    Each partition's edges are first replaced by a spanning forest.  Each round then takes a constant number of shuffles over edges
    that only get fewer, until they fit one task or stand still; the number of rounds grows with the logarithm of the
    largest component.  A hub's least neighbour is a partial minimum, joined back, so that no task has to hold a neighbourhood.
    Null ends are no edges; repeated edges count once; an empty table gives no rows; further columns are ignored."""
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    e = scratch(e.mapInArrow(_spanning, "a long, b long").toDF("u", "v"), "edges")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        if now[0] <= few:
            done = scratch(e.toDF("a", "b").coalesce(1).mapInArrow(_spanning, "a long, b long").toDF("u", "v"), "edges")
            discard(e)
            e = done
            break
        before = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("v", "m").union(small.select("u", "m")).where("v <> m").toDF("u", "v").distinct()
        after = scratch(small, "edges")
        discard(e)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
