"""Conversation memory: turns by session, idle sessions forgotten, the latest turns kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TURNS, CONTEXT, IDS = 10, 3, 5


def sessions(turns: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """turns (session_id, ts): sessions with their turn counts, closed by the idle gap."""
    return turns.groupBy(F.session_window("ts", gap).alias("w"), "session_id").agg(F.count("*").alias("turns")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns")


def memory(turns: DataFrame, last: int = TURNS) -> DataFrame:
    """The last turns of every session with ``number``, 1 for the oldest kept; turns carry seq."""
    w = Window.partitionBy("session_id")
    kept = turns.withColumn("_n", F.row_number().over(w.orderBy(F.desc("seq")))).where(F.col("_n") <= last)
    return kept.withColumn("number", F.max("_n").over(w) - F.col("_n") + 1).drop("_n")


def prior_ids(turns: DataFrame) -> DataFrame:
    """(session_id, paper_ids): ids of the kept turns, newest turn first, each once."""
    t = memory(turns).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("seq", "paper_ids")), asc=False).alias("t"))
    return t.select("session_id", F.array_distinct(F.flatten(F.transform("t", lambda x: x["paper_ids"]))).alias("paper_ids"))


def context(turns: DataFrame, last: int = CONTEXT) -> DataFrame:
    """(session_id, context): a block of the last turns, numbered, with at most five ids each."""
    line = F.concat(F.lit("Turn "), F.col("number").cast("string"), F.lit(": "), F.col("query"), F.when(F.size("paper_ids") > 0, F.concat(F.lit(" ["), F.array_join(F.slice("paper_ids", 1, IDS), ", "), F.lit("]"))).otherwise(""))
    rows = memory(turns, last).select("session_id", F.struct("number", line.alias("line")).alias("x"))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("context"))


def turn_of(query, answer, ids):
    """A stored turn: answer cut at 300 characters, at most ten ids."""
    return F.struct(query.alias("query"), F.substring(answer, 1, 300).alias("ai_response_summary"), F.slice(ids, 1, 10).alias("paper_ids"))


def memory_stream(turns: DataFrame, idle_minutes: int = 30, last: int = TURNS) -> DataFrame:
    """On a stream with a watermark on ts: after each batch, (session_id, turns kept, evicted) of the sessions it touched, and idle ones as they expire.

    State is a session's last turns; it goes when the watermark passes the idle time. A cap on the number of sessions
    over all keys is not a keyed state and has no counterpart here.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n = len(state.get[0])
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "turns": [n], "evicted": [True]})
            return
        kept = list(state.get[0]) if state.exists else []
        latest = 0
        for row in pd.concat(batches).sort_values("ts").itertuples():
            now = int(row.ts.timestamp() * 1000)
            if kept and now - kept[-1] > idle_minutes * 60_000:
                kept = []
            kept, latest = (kept + [now])[-last:], max(latest, now)
        state.update((kept,))
        state.setTimeoutTimestamp(latest + idle_minutes * 60_000)
        yield pd.DataFrame({"session_id": [key[0]], "turns": [len(kept)], "evicted": [False]})

    kind = turns.schema["session_id"].dataType.simpleString()
    return turns.groupBy("session_id").applyInPandasWithState(step, f"session_id {kind}, turns int, evicted boolean", "times array<long>", "append", "EventTimeTimeout")
