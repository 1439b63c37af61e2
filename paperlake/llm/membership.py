"""Splitting a table by whether its keys may occur in another one, so that only those rows are shuffled to a join."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .url_filter import BlockedBloom


def split_by_key(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in keys, rows whose key surely is not); together they are all rows.

    The blocked Bloom filter between them has a size bound of its own, whatever the number of keys; past it more
    rows count as possible. Nulls in keys are values like others here.
    """
    key = F.xxhash64(*on)
    wanted = keys.select(key.alias("key"))
    shared = rows.sparkSession.sparkContext.broadcast(BlockedBloom.build(wanted, keys.count()).words)

    @F.pandas_udf("boolean")
    def may_hold(keys: pd.Series) -> pd.Series:
        return pd.Series(BlockedBloom(shared.value).may_hold(keys.to_numpy(np.int64)))

    return rows.where(may_hold(key)), rows.where(~may_hold(key))
