"""URL filters: a blocked Bloom filter in front of an exact hash join.

The list holds canonical URL prefixes (host, path) with a verdict. A URL fits a listed prefix when its host is the
listed host or a subdomain of it and its path starts with the listed path; the longest listed string wins and a URL
that fits none gets ``default``. For each distinct URL the possible keys are its host's suffixes at label borders
times its path's prefixes of the lengths that occur in the list. The Bloom filter drops nearly all of them; the rest
meet the list in an exact hash join, so false positives never decide.

The filter is blocked: the hash picks one block of 512 bits and all probes fall in it. It is built in parallel
(blocks are OR-ed by an aggregate) and has at most ``MAX_BLOCKS`` blocks (16 MB), whatever the list's length, which
bounds what is broadcast; a list that outgrows it only passes more false positives to the join.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no rule; repeated rows and ids
are judged row by row; rules with a null host or path are ignored, and of rules with the same host and path "block"
wins; an empty table or list gives an empty result or the default verdict; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, cut, named

BLOCK_WORDS, PROBES, BITS_PER_KEY, MAX_BLOCKS = 8, 8, 16, 1 << 18


def url_parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, UPPER, UPPER.lower()), path


def _bits(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number of each 64-bit key, and its 512-bit pattern as 8 words."""
    x = keys.astype(np.uint64)
    block = ((x >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    words = np.zeros((len(x), BLOCK_WORDS), np.uint64)
    step = (x & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    rows = np.arange(len(x))
    for k in range(PROBES):
        at = (step * np.uint64(2 * k + 1)) >> np.uint64(55)
        words[rows, (at >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (at & np.uint64(63))
    return block, words


class BlockedBloom:
    """A blocked Bloom filter over 64-bit keys."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def build(cls, keys: DataFrame, count: int) -> BlockedBloom:
        """keys: one long column ``key``; at most MAX_BLOCKS blocks come to the driver."""
        blocks = int(min(MAX_BLOCKS, max(1, 1 << (max(1, count * BITS_PER_KEY) // 512).bit_length())))
        names = [f"w{k}" for k in range(BLOCK_WORDS)]

        def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                block, words = _bits(b["key"].to_numpy(np.int64), blocks)
                yield pd.DataFrame({"block": block} | {n: words[:, k].astype(np.int64) for k, n in enumerate(names)})

        schema = "block long, " + ", ".join(f"{n} long" for n in names)
        merged = keys.select("key").mapInPandas(patterns, schema).groupBy("block").agg(*[F.bit_or(n).alias(n) for n in names])
        words = np.zeros((blocks, BLOCK_WORDS), np.uint64)
        got = merged.toPandas()
        words[got["block"].to_numpy(np.int64)] = got[names].to_numpy(np.int64).astype(np.uint64)
        return cls(words)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        block, want = _bits(keys, len(self.words))
        return ((self.words[block] & want) == want).all(axis=1)


def key_of(host: Column, path: Column) -> Column:
    return F.xxhash64(host, F.lit("\n"), path)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (host and path of the winning rule or null), verdict.

    rules: host, path, verdict.
    """
    spark = pages.sparkSession
    listed = (
        rules.where("host is not null and path is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("key", key_of(F.col("host"), F.col("path")))
    )
    shape = listed.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths")).first()
    bloom = spark.sparkContext.broadcast(BlockedBloom.build(listed, shape["n"]).words)

    @F.pandas_udf("boolean")
    def may_be_listed(key: pd.Series) -> pd.Series:
        return pd.Series(BlockedBloom(bloom.value).may_hold(key.to_numpy(np.int64)))

    host, path = url_parts(F.col("url"))
    parsed = pages.select(named(id_col).alias("id"), named(url_col).cast("string").alias("url")).withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    lengths = F.lit(shape["lengths"] or [0]).cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    tried = (
        parsed.where("url is not null and host <> ''")
        .select("url", "host", "path")
        .distinct()
        .select("url", F.explode(suffixes).alias("host"), prefixes.alias("prefixes"))
        .select("url", "host", F.explode("prefixes").alias("path"))
        .withColumn("key", key_of(F.col("host"), F.col("path")))
        .where(may_be_listed("key"))
    )
    exact = tried.join(listed, ["key", "host", "path"])
    longest = F.max(F.struct((F.length("host") + F.length("path")).alias("n"), F.concat("host", "path").alias("rule"), "verdict")).alias("best")
    # Written first, so that the join reads two plain exchanges and a very common URL can be split; null URLs need no join.
    best = cut(exact.groupBy("url").agg(longest))
    judged = parsed.where("url is not null").join(best, "url", "left")
    missing = parsed.where("url is null").withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    return judged.unionByName(missing).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
