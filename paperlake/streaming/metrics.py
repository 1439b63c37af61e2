"""Metric series: rates, gauges, quantiles from histogram buckets, hit rates and alerts, for batch and stream alike.

Functions take (ts, metric, value) frames. On a stream, give the frame a watermark first; all but alerts then run in
append mode as they stand. Alerts need a run of windows and have a stateful twin in ``alerts_stream``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Upper edges of the search-latency histogram.
BUCKETS = (0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0)


def rate(events: DataFrame, width: str = "5 minutes", step: str | None = None, value=None) -> DataFrame:
    """Increase per second in each window: of counted events, or of a value."""
    w = F.window("ts", width, step) if step else F.window("ts", width)
    total = F.sum(value) if value is not None else F.count("*")
    return events.groupBy(w.alias("w"), "metric").agg(total.cast("double").alias("increase")).select("metric", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "increase", (F.col("increase") / (F.unix_timestamp("w.end") - F.unix_timestamp("w.start"))).alias("rate"))


def gauge(events: DataFrame, width: str) -> DataFrame:
    """The latest value of each window, ties by value."""
    return events.groupBy(F.window("ts", width).alias("w"), "metric").agg(F.max_by("value", F.struct("ts", "value")).alias("value")).select("metric", F.col("w.start").alias("start"), "value")


def histogram_quantile(events: DataFrame, width: str, q: float, edges: Sequence[float] = BUCKETS) -> DataFrame:
    """Linear interpolation inside the bucket that holds the rank q * n; beyond the last edge, the last edge."""
    counts = [F.count_if(F.col("value") <= e).alias(f"c{i}") for i, e in enumerate(edges)]
    t = events.groupBy(F.window("ts", width).alias("w"), "metric").agg(F.count("*").alias("n"), *counts)
    rank, out = F.col("n") * q, F.lit(float(edges[-1]))
    for i in range(len(edges) - 1, -1, -1):
        below, lo = (F.col(f"c{i - 1}"), edges[i - 1]) if i else (F.lit(0), 0.0)
        inside = F.col(f"c{i}") - below
        out = F.when(F.col(f"c{i}") >= rank, F.lit(lo) + (edges[i] - lo) * F.when(inside > 0, (rank - below) / inside).otherwise(1.0)).otherwise(out)
    return t.select("metric", F.col("w.start").alias("start"), "n", out.alias("quantile"))


def hit_rate(events: DataFrame, width: str, hit) -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "metric").agg((F.count_if(hit) / F.greatest(F.lit(1), F.count("*")) * 100).alias("hit_rate")).select("metric", F.col("w.start").alias("start"), "hit_rate")


def alerts(windows: DataFrame, breached, hold: int, width: float) -> DataFrame:
    """windows (metric, start, ...) of ``width`` seconds: runs of at least ``hold`` windows, each beginning where the last one ends,
    in which the condition holds, with when they begin, fire and end. A missing window ends a run."""
    w = Window.partitionBy("metric").orderBy("start")
    bad = windows.where(F.coalesce(breached, F.lit(False)))
    runs = bad.withColumn("_run", F.round(F.unix_micros(F.col("start").cast("timestamp")) / F.lit(width * 1e6)).cast("long") - F.row_number().over(w))
    got = runs.groupBy("metric", "_run").agg(F.count("*").alias("windows"), F.min("start").alias("begins"), F.max("start").alias("ends"), F.array_sort(F.collect_list("start")).alias("_s"))
    return got.where(F.col("windows") >= hold).select("metric", "begins", F.get("_s", F.lit(hold - 1)).alias("fires"), "ends", "windows")


def alerts_stream(windows: DataFrame, threshold: float, hold: int, width: float) -> DataFrame:
    """(metric, start) of firing windows on a stream of (metric, start, value) in order of start: a counter of bad windows a metric.

    A run goes on only in the window of ``width`` seconds that follows its last one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run, last = state.get if state.exists else (0, 0.0)
        fired = []
        for row in pd.concat(batches).sort_values("start").itertuples():
            now = row.start.timestamp()
            run = ((run if now - last <= width else 0) + 1) if row.value > threshold else 0
            last = now
            if run == hold:
                fired.append(row.start)
        state.update((run, last))
        yield pd.DataFrame({"metric": [key[0]] * len(fired), "start": pd.to_datetime(fired)})

    return windows.groupBy("metric").applyInPandasWithState(step, "metric string, start timestamp", "run int, last double", "append", "NoTimeout")


def exposition(events: DataFrame) -> DataFrame:
    """Counters and sums as text lines, one a metric."""
    t = events.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("s"))
    return t.select("metric", F.concat(F.lit("# TYPE "), "metric", F.lit(" summary\n"), "metric", F.lit("_count "), F.col("n").cast("string"), F.lit("\n")).alias("text"), F.col("s").alias("total"))
