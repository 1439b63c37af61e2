"""A result cache with a time to live and a bound on its entries, least recently used first: what it would answer, in batch and on a stream.

Requests (ts, request_id, key) are dealt to shards by a hash of their key; each shard is a cache of its own with a bounded
number of entries, which is what its state holds. A shard's requests are taken in the order of time and request.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "request_id long, key string, shard int, hit boolean, expired boolean, evicted string"


class LruTtl:
    """Keys with the time at which they were stored, the least recently used first."""

    def __init__(self, entries: int, ttl: float, held=()):
        self.entries, self.ttl, self.held = entries, ttl, OrderedDict(held)

    def ask(self, key: str, now: float) -> tuple[bool, bool, str | None]:
        """(hit, whether an entry had expired, the key that had to go for this one)."""
        stored = self.held.pop(key, None)
        if stored is not None and now - stored < self.ttl:
            self.held[key] = stored
            return True, False, None
        gone = self.held.popitem(last=False)[0] if len(self.held) >= self.entries else None
        self.held[key] = now
        return False, stored is not None, gone


def _answers(shard: int, rows: pd.DataFrame, cache: LruTtl) -> pd.DataFrame:
    rows = rows.sort_values(["ts", "request_id"])
    said = [cache.ask(k, t.timestamp()) for k, t in zip(rows["key"], rows["ts"], strict=True)]
    return pd.DataFrame({"request_id": rows["request_id"].to_list(), "key": rows["key"].to_list(), "shard": shard, "hit": [x[0] for x in said], "expired": [x[1] for x in said], "evicted": [x[2] for x in said]})


def _sharded(requests: DataFrame, shards: int) -> DataFrame:
    return requests.where("key is not null").select("ts", "request_id", "key", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))


def cache_answers(requests: DataFrame, entries: int = 100, ttl: float = 3600, shards: int = 8) -> DataFrame:
    """Hit or miss of each request; more shards make smaller tasks and smaller caches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, cache = None, None
        for b in batches:
            for k, rows in b.groupby("shard", sort=False):
                if k != shard:
                    shard, cache = k, LruTtl(entries, ttl)
                yield _answers(k, rows, cache)

    ordered = _sharded(requests, shards).repartition("shard").sortWithinPartitions("shard", "ts", "request_id")
    return ordered.mapInPandas(run, OUT)


def cache_stream(requests: DataFrame, entries: int = 100, ttl: float = 3600, shards: int = 8) -> DataFrame:
    """The same on a stream whose batches come in the order of time; the state of a shard is its entries."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = zip(*state.get, strict=True) if state.exists else ()
        cache = LruTtl(entries, ttl, held)
        yield _answers(key[0], pd.concat(batches), cache)
        state.update((list(cache.held), list(cache.held.values())))

    return _sharded(requests, shards).groupBy("shard").applyInPandasWithState(step, OUT, "keys array<string>, stored array<double>", "append", "NoTimeout")


def cache_statistics(answers: DataFrame) -> DataFrame:
    """One row: requests, hits, misses, expired entries, evictions and the hit rate in percent."""
    n, hits = F.count("*"), F.count_if("hit")
    return answers.agg(n.alias("requests"), hits.alias("hits"), (n - hits).alias("misses"), F.count_if("expired").alias("expired"), F.count("evicted").alias("evictions"), (F.coalesce(F.try_divide(hits, n), F.lit(0.0)) * 100).alias("hit_rate"))
