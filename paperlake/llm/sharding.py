"""Sharding by a two-pass external shuffle: a seeded permutation of all records, cut into shards of equal counts.

First pass: a seeded hash of a record's id and text scatters the records uniformly into buckets of some ``BUCKET_BYTES``
of text. Spark's shuffle carries them; a task holds many buckets, sorted by bucket on its disk. Second pass: bucket
after bucket is read into memory, put in the order of the hash, Fisher-Yates shuffled by a generator seeded with the
seed and the bucket's number, and written. Buckets laid end to end are the permutation. Its prefix sums need one
row a bucket, and cutting it into ``shards`` runs whose lengths differ by one at most gives each record its shard and its
slot. This is the law ``rows``: counts are at most one apart whatever the records are.

Records are written once with bucket and place, so shard and slot are a join with the buckets' starts: broadcast up to
``BROADCAST_BUCKETS`` of them, else by a shuffle. ``write_shards`` writes one folder a shard, in the order of the slots.

A record that occurs so often that its copies fill a quarter of a bucket is a crowd: its copies have equal hashes, so
a seeded random number spreads them over all buckets instead. Only copies of the same id and text have it, and these are
interchangeable; everything else lands in the same bucket in every run with the same seed over the same table.

Defined cases: null text has no bytes (a record's size is its text's bytes and one more); null ids are hashed as null and
need no rank among others; equal rows are records of their own; very long texts are whole in one bucket, which then
holds more than its share; an empty table gives an empty result; fewer records than shards leave the last ones empty;
other columns travel in the struct ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, named, text_of

SHARDS, SEED = 16, 20_240_607
#: Bytes of text in a bucket; tables too small for MIN_BUCKETS such buckets have smaller ones, for tasks to share.
BUCKET_BYTES, MIN_BUCKETS = 64 << 20, 64
BROADCAST_BUCKETS, BROADCAST_CROWDS = 1_000_000, 1_000_000
#: Rows of a batch that a task hands on.
BATCH = 2048


def fisher_yates(n: int, seed: int, bucket: int) -> list[int]:
    """A permutation of range(n): from the last place down, each is swapped with one at or before it."""
    out = list(range(n))
    draws = np.random.Generator(np.random.PCG64([seed, bucket])).integers(0, np.arange(n, 0, -1)).tolist()
    for i, j in zip(range(n - 1, -1, -1), draws, strict=True):
        out[i], out[j] = out[j], out[i]
    return out


def _shuffled(seed: int):
    """Sorted rows in, each bucket's rows out in the order of its permutation, with their places in ``pos``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            order = fisher_yates(len(rows), seed, last)
            for s in range(0, len(order), BATCH):
                part = rows.take(pa.array(order[s : s + BATCH], pa.int64()))
                place = pa.array(np.arange(s, s + len(part)), pa.int64())
                out = pa.table([*(part[c] for c in ("bucket", "size", "row")), place], names=["bucket", "size", "row", "pos"])
                yield from out.to_batches()

        for b in batches:
            buckets = b.column("bucket").to_numpy()
            ends = [*np.flatnonzero(np.diff(buckets)) + 1, len(b)]
            for lo, hi in zip([0, *ends], ends, strict=False):
                if hi > lo:
                    if held and buckets[lo] != last:
                        yield from flush()
                    last = int(buckets[lo])
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield from flush()

    return run


def permuted(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """(bucket, pos, size, row), written; the number of buckets. row: a struct of all columns of docs."""
    sized = docs.select(
        F.struct(*[named(c) for c in docs.columns]).alias("row"),
        (F.octet_length(text_of(text_col)) + F.lit(1).cast("long")).alias("size"),
        F.xxhash64(F.lit(seed), named(id_col), text_of(text_col)).alias("key"),
    )
    keys = cut(sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-total // bucket_bytes))
    # At most four a bucket.
    crowds = keys.where((F.col("n") > 1) & (F.col("bytes") * (4 * buckets) > total)).select("key", F.lit(True).alias("crowd"))
    n = crowds.count()
    if n:
        placed = sized.join(F.broadcast(crowds) if n <= BROADCAST_CROWDS else crowds, "key", "left")
        place = F.when(F.col("crowd"), F.floor(F.rand(seed) * buckets)).otherwise(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(buckets)))
    else:
        placed, place = sized, F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(buckets))
    scattered = placed.select(place.cast("long").alias("bucket"), "key", "size", "row")
    rows = scattered.repartition("bucket").sortWithinPartitions("bucket", "key").select("bucket", "size", "row")
    out = cut(rows.mapInArrow(_shuffled(seed), f"bucket long, size long, row {dict(rows.dtypes)['row']}, pos long"))
    drop_cut(keys)
    return out, buckets


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **options) -> DataFrame:
    """(row, size, shard, slot): all records, each once; row holds the columns of docs."""
    rows, buckets = permuted(docs, seed, **options)
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total")))
    index, total = F.col("start") + F.col("pos"), F.col("total")
    which = F.expr(f"(start + pos) * {int(shards)}L DIV total").cast("int")
    done = rows.join(F.broadcast(starts) if buckets <= BROADCAST_BUCKETS else starts, "bucket").withColumns({"index": index, "shard": which})
    return done.select("row", "size", "shard", (F.col("index") - _first_of(F.col("shard"), total, shards)).alias("slot"))


def _first_of(which: Column, total: Column, shards: int) -> Column:
    """The index at which a shard starts: the smallest i with i * shards // total at this shard, in exact arithmetic."""
    whole, rest = F.expr(f"total DIV {int(shards)}"), total % shards
    return which * whole + F.ceil((which * rest) / F.lit(shards)).cast("long")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **options) -> DataFrame:
    """Write the shards as Parquet folders ``shard=0`` and so on, rows in the order of ``slot``; returns what was written."""
    done = shard(docs, shards, **options)
    done.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(done.schema).parquet(path)
