"""Mixing sources to target weights.

A source's documents, in order of (bucket of the id's hash, id), are one stream of tokens, cut into blocks of fixed length.
The output has as many blocks as the corpus, in shards of a fixed number of slots.  For each shard the number of slots of
each source is drawn from a multinomial over the target weights; a source's k-th slot over all shards takes the block at
place k modulo the number of its blocks in a pseudorandom permutation, a new one each time round, so no block comes again before
all have come.  The permutation is a keyed four-round Feistel network walked until it lands within range: any slot is
mapped by itself, and nothing of the corpus's size is held or sorted.  Where a shard's slots begin in each source's sequence is a prefix
sum over groups of shards, taken in Spark.  Blocks and slots are joined by (source, index), both sides shuffled: slots grow with the corpus,
so they are never broadcast.

A token is a run of non-space characters with the space before it; a text's trailing space belongs to none.  Prefix sums are taken in two
levels (bucket totals, then within a bucket), so a hot source is spread over many tasks.  The text is shuffled twice: to
its bucket, and to its block.

Defined results: a null source is a source of its own; null, empty and blank texts have no tokens and no place in the mixture;
rows with equal ids follow each other in the order of a hash of their tokens, then of the language; a null id comes first and is carried; a source's last
block may be short; a target weight for a source without tokens is dropped and the rest scaled; a source without a
target weight gets none, if weights are given; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import narrowed, scratch, small_side

BLOCK_TOKENS, SHARD_SLOTS, TEMPERATURE, SEED = 512, 256, 0.7, 17
ROWS_A_BUCKET, BUCKETS_A_TASK = 500, 8
GROUP = 1024  # shards whose slots one row of the slot table's plan stands for
NULL_SOURCE = "\u0000null"


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of each index under the pseudorandom permutation of range(size) that key picks."""
    index, size, key = (np.asarray(x).astype(np.uint64) for x in (index, size, key))
    half = np.ones(len(size), np.uint64)
    while (short := (np.uint64(1) << (np.uint64(2) * half)) < size).any():
        half[short] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.copy()
    todo = np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            x = (right + k + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(32)
            left, right = right, left ^ (x & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def source_key(source: str, turn: int, seed: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}/{source}/{turn}".encode()).digest()[:8], "big")


def shard_counts(shard: int, slots: int, weights: np.ndarray, seed: int) -> np.ndarray:
    """Slots of each source in a shard; a shard's draw depends on nothing but its number."""
    return np.random.default_rng([seed, shard]).multinomial(slots, weights)


def draw_slots(tokens: dict[str, int], weights: dict[str, float] | None, block: int, slots: int, alpha: float, seed: int) -> tuple[list[str], np.ndarray, np.ndarray, int]:
    """(sources, blocks of each, weight of each, slots in all)."""
    names = sorted(s for s, n in tokens.items() if n > 0)
    blocks = np.array([-(-tokens[s] // block) for s in names], np.int64)
    if weights is None:
        w = np.array([float(tokens[s]) for s in names]) ** alpha
    else:
        w = np.array([max(0.0, float(weights.get(s, 0))) for s in names])
    if not names or w.sum() <= 0:
        return names, blocks, np.zeros(len(names)), 0
    return names, blocks, w / w.sum(), int(blocks.sum())


def slot_table(spark: SparkSession, names: list[str], blocks: np.ndarray, weights: np.ndarray, total: int, slots: int, seed: int, group: int = GROUP) -> DataFrame:
    """(shard, slot, source, turn, block) of every slot.

    A shard's place in each source's sequence is the sum of the draws before it.  Each group of shards adds up its own draws, a prefix
    sum over groups (a row for every group and source) gives where it starts, and the group is drawn again to place its slots."""
    shards = math.ceil(total / slots)
    n_groups = math.ceil(shards / group)

    def drawn(g: int) -> Iterator[tuple[int, int, np.ndarray]]:
        for s in range(g * group, min(shards, (g + 1) * group)):
            n = min(slots, total - s * slots)
            yield s, n, shard_counts(s, n, weights, seed)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column("id").to_pylist():
                n = sum(counts for _, _, counts in drawn(g))
                yield pa.record_batch({"g": pa.array(np.full(len(n), g), pa.int64()), "which": pa.array(range(len(n)), pa.int32()), "n": pa.array(n, pa.int64())})

    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, starts in zip(batch.column("g").to_pylist(), batch.column("starts").to_pylist()):
                at = np.array([x["start"] for x in starts], np.int64)
                for s, n, counts in drawn(g):
                    which = np.repeat(np.arange(len(names)), counts)
                    k = at[which] + np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
                    at += counts
                    turn = k // blocks[which]
                    keys = {(w, t): source_key(names[w], t, seed) for w, t in set(zip(which.tolist(), turn.tolist()))}
                    key = np.array([keys[x] for x in zip(which.tolist(), turn.tolist())], np.uint64)
                    block = permuted(k % blocks[which], blocks[which], key)
                    place = np.random.default_rng([seed, s, 1]).permutation(n)  # sources are interleaved within a shard
                    yield pa.record_batch({"shard": pa.array(np.full(n, s), pa.int64()), "slot": pa.array(place, pa.int32()), "source": pa.array([names[w] for w in which]), "turn": pa.array(turn, pa.int64()), "block": pa.array(block, pa.int64())})

    draws = spark.range(0, n_groups, numPartitions=max(1, math.ceil(n_groups / 8))).mapInArrow(summed, "g long, which int, n long")
    before = Window.partitionBy("which").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    starts = draws.select("g", "which", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = starts.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("which", "start"))).alias("starts"))  # as many as there are sources
    starts = scratch(starts, "draws").repartition(max(1, math.ceil(n_groups / 8)), "g")
    return starts.mapInArrow(slots_of, "shard long, slot int, source string, turn long, block long")


def token_pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))


def segments(docs: DataFrame, block: int) -> tuple[DataFrame, dict[str, int]]:
    """((source, block, at, doc_id, lang, n, text): a document's part of a block; tokens of each source)."""
    spark = docs.sparkSession
    docs = narrowed(docs, doc_id="long", text="string", lang="string", source="string")
    docs = docs.withColumn("source", F.coalesce("source", F.lit(NULL_SOURCE)))
    rows = docs.count()
    buckets = max(1, math.ceil(rows / ROWS_A_BUCKET))
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    counted = docs.groupBy("source", "bucket").agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long")).alias("tokens"))
    counted = scratch(counted, "tokens")
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("source", "bucket", F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("base"))
    totals = {r.source: r.tokens for r in counted.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    starts = small_side(scratch(starts, "starts"), 64)

    moved = docs.where(F.length(F.trim("text")) > 0).repartition(max(1, math.ceil(buckets / BUCKETS_A_TASK)), "bucket")
    words = moved.withColumn("words", token_pieces(F.col("text"))).drop("text").withColumn("n", F.size("words")).where("n > 0")
    w = Window.partitionBy("bucket", "source").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("words"), "lang").rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    words = words.join(starts, ["source", "bucket"]).withColumn("start", F.col("base") + F.col("before"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n") - 1) / block)
    cut = words.withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.lit(0), F.col("block") * block - F.col("start")).cast("int")
    hi = F.least(F.col("n"), (F.col("block") + 1) * block - F.col("start")).cast("int")
    cut = cut.select("source", "block", (F.col("start") + lo).alias("at"), "doc_id", "lang", (hi - lo).alias("n"), F.array_join(F.slice("words", lo + 1, hi - lo), "").alias("text"))
    return cut, totals


def mix_segments(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK_TOKENS, slots: int = SHARD_SLOTS, alpha: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, turn, block, at, doc_id, lang, n, text): the documents' parts of the drawn blocks."""
    parts, tokens = segments(docs, block)
    names, blocks, w, total = draw_slots(tokens, weights, block, slots, alpha, seed)
    table = slot_table(docs.sparkSession, names, blocks, w, total, slots, seed)
    return parts.join(table.hint("shuffle_hash"), ["source", "block"]).withColumn("source", F.when(F.col("source") != NULL_SOURCE, F.col("source")))


def mix_blocks(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK_TOKENS, slots: int = SHARD_SLOTS, alpha: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, turn, block, n_tokens, doc_ids, starts, text), a row for each slot of each output shard.

    weights: share of each source; by default its tokens to the power alpha. doc_ids and starts: the documents in the block,
    and where in it each begins. text: the tokens, documents apart by an empty line."""
    parts, tokens = segments(docs, block)
    names, blocks, w, total = draw_slots(tokens, weights, block, slots, alpha, seed)
    table = slot_table(docs.sparkSession, names, blocks, w, total, slots, seed)
    packed = parts.groupBy("source", "block").agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "doc_id", "text"))).alias("parts"))
    out = packed.join(table.hint("shuffle_hash"), ["source", "block"])
    return out.select(
        "shard", "slot", F.when(F.col("source") != NULL_SOURCE, F.col("source")).alias("source"), "turn", "block", F.col("n_tokens").cast("int").alias("n_tokens"),
        F.col("parts.doc_id").alias("doc_ids"), F.transform("parts.at", lambda a: (a - F.col("block") * block).cast("int")).alias("starts"),
        F.array_join("parts.text", "\n\n").alias("text"),
    )


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK_TOKENS, slots: int = SHARD_SLOTS, alpha: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The mixture in the columns of documents: each row is a document's part of a drawn block, under the document's id."""
    out = mix_segments(docs, weights, block, slots, alpha, seed)
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
