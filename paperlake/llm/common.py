"""Helpers shared by the training-data operators: cut points, text columns, connected components."""

from __future__ import annotations

import ctypes
import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import forget as drop_cut
from ..sources.scratch import kept

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def named(column: str) -> Column:
    """The column of this very name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def text_of(column: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(named(column).cast("string"), F.lit(""))


def long_id(docs: DataFrame, column: str) -> Column:
    """The id as a long; ids of other types than integers are refused."""
    kind = next(f.dataType for f in docs.schema.fields if f.name == column)
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise ValueError(f"{column} has to be an integer column here, not {kind.simpleString()}")
    return named(column).cast("long")


def worker_memory(name: str, make):
    """An object that a Python process keeps, a worker for all its tasks; functions travel by value, so their globals do not last.

    A worker keeps one object: what an earlier operator left in it goes first.
    """
    held = sys.modules.setdefault("_paperlake_worker", types.ModuleType("_paperlake_worker")).__dict__
    if held.get("kept", ("", None))[0] != name:
        held["kept"] = ("", None)
        held["kept"] = (name, make())
    return held["kept"][1]


def give_back() -> None:
    """What this process has freed goes back to the system, as far as its allocators can (glibc; others keep theirs)."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def tidy(run, keeps: bool = False):
    """run, a function for mapInArrow, that leaves its worker as small as it can: idle workers count against an executor's memory.

    What an earlier operator left in the worker goes first (not if run keeps an object of its own there), and what was freed is given back.
    """

    def done(batches):
        if not keeps and "_paperlake_worker" in sys.modules:
            sys.modules["_paperlake_worker"].__dict__["kept"] = ("", None)
        try:
            yield from run(batches)
        finally:
            give_back()

    return done


def cut(df: DataFrame) -> DataFrame:
    """Write df into the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    return kept(df, "cut", compression="zstd")


#: Edges that one task holds while it makes their spanning forest.
FOREST_EDGES = 500_000


def forest(batches):
    """The edges of some batches as a spanning forest of stars: (hi, lo) of each node and the smallest one it reaches."""
    import numpy as np

    up: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    for b in batches:
        for a, c in zip(b.column("hi").to_pylist(), b.column("lo").to_pylist(), strict=True):
            a, c = top(a), top(c)
            if a != c:
                up[max(a, c)] = min(a, c)
    nodes = np.fromiter(up, np.int64, len(up))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([top(x) for x in nodes.tolist()], pa.int64())], names=["hi", "lo"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long pairs: (node, root) with root the smallest node reachable, for nodes other than the root.

    Tasks of at most FOREST_EDGES edges first make spanning forests of their own edges; if one task was enough, that is
    the answer. Then each round hooks every node to its smallest smaller neighbour, links its other smaller
    neighbours to that one and jumps one pointer. Aggregates combine before the shuffle, so a node with very many links
    costs no more than others; rounds grow with the logarithm of the longest path. Self-loops and nulls are ignored.
    """
    given = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")))
    tasks = -(-given.count() // FOREST_EDGES)
    links = cut(given.repartition(max(1, tasks)).mapInArrow(tidy(forest), "hi long, lo long"))
    drop_cut(given)
    if tasks <= 1:
        return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    for _ in range(rounds):
        parent = links.groupBy("hi").agg(F.min("lo").alias("up"), F.count("*").alias("n"))
        up = cut(parent)
        state = up.agg(F.max("n").alias("n")).first()
        if state["n"] is None:
            break
        over = up.select(F.col("hi").alias("up"), F.col("up").alias("over"))
        jumped = up.select("hi", "up").join(over, "up", "left")
        if state["n"] == 1 and jumped.where("over is not null").isEmpty():
            drop_cut(links)
            return up.select(F.col("hi").alias("node"), F.col("up").alias("root"))
        hooked = jumped.select("hi", F.coalesce("over", "up").alias("lo"))
        if state["n"] > 1:
            side = (
                links.join(up.where("n > 1"), "hi")
                .where("lo <> up")
                .select(F.col("lo").alias("hi"), F.col("up").alias("lo"))
            )
            hooked = hooked.unionByName(side).distinct()
        nxt = cut(hooked)
        drop_cut(links)
        drop_cut(up)
        links = nxt
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
