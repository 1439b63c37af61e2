"""Embedding near-dedup: an epsilon grid order join on cosine similarity.

Unit vectors have cosine c exactly at distance sqrt(2 - 2c) = epsilon. Distinct vectors are projected on their
leading principal directions (fitted on a bounded sample, which affects speed only), sorted by grid cells of width
epsilon on the first ``CELL_DIMS`` of them and cut into sequence intervals of some ``INTERVAL_BYTES`` with a bounding
box. Two intervals meet only if they have neighbouring cells and their boxes come within epsilon. The pairs of intervals
are made of names and boxes; of the second interval only those vectors then travel that lie within epsilon of the
first one's box, in the precision that the input has. A meeting splits both sides again and again, dropping halves whose
boxes are farther apart than epsilon, and compares what is left by a matrix product: clear cases in single precision,
any within ``MARGIN`` of the threshold once more in double precision.

Equal vectors are one vector with a count, so a very common vector costs no more than another. A meeting sends back a
count of links for each vector and a spanning forest of its links, never the links themselves, so dense groups stay
linear in their size.

Vectors are scaled by their largest component before they are squared, so very large and very small ones count, too.

Defined cases: ids are integers, others are refused with a ValueError; vectors that are null, empty or zero, or hold null or non-finite components, and rows without an id link with
nothing; vectors of different lengths never link; equal rows, ids included, count as links of each other; ties need
no order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, drop_cut, long_id, named

SAMPLE, BOX_DIMS, CELL_DIMS, LEAF, MARGIN = 10_000, 8, 3, 512, 1e-4
#: Bytes of an interval's vectors; one of very long vectors has a single vector.
INTERVAL_BYTES = 2 << 20


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def principal(sample: list[np.ndarray]) -> dict[int, np.ndarray]:
    """For each length of vector, its leading directions as columns."""
    out = {}
    for n in {len(v) for v in sample}:
        x = unit(np.stack([v for v in sample if len(v) == n]))
        _, axes = np.linalg.eigh(np.cov(x.T).reshape(n, n) if len(x) > 1 else np.eye(n))
        out[n] = axes[:, ::-1][:, :BOX_DIMS]
    return out


class Forest:
    """Union-find over long ids, the smallest id on top."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class Meeting:
    """Counts and a spanning forest of the links between two intervals (or within one)."""

    def __init__(self, least: float):
        self.least, self.eps, self.forest = least, float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6, Forest()

    def run(self, a: tuple, b: tuple, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """a, b: ids, copies, unit vectors, projections. Weighted links of a's and of b's vectors."""
        self.a, self.b = a, b
        self.na, self.nb = np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), np.int64)
        self.a32, self.b32 = a[2].astype(np.float32), b[2].astype(np.float32)
        self.split(0, len(a[0]), 0, len(b[0]), same)
        return self.na, self.nb

    def split(self, i: int, j: int, k: int, m: int, same: bool) -> None:
        if i == j or k == m or (same and k < i):
            return
        pa_, pb = self.a[3][i:j], self.b[3][k:m]
        gap = np.maximum(0, np.maximum(pa_.min(0) - pb.max(0), pb.min(0) - pa_.max(0)))
        if (gap * gap).sum() > self.eps**2:
            return
        if j - i <= LEAF and m - k <= LEAF:
            self.leaf(i, j, k, m, same)
            return
        left = [(i, j)] if j - i <= LEAF else [(i, (i + j) // 2), ((i + j) // 2, j)]
        right = [(k, m)] if m - k <= LEAF else [(k, (k + m) // 2), ((k + m) // 2, m)]
        for x in left:
            for y in right:
                self.split(*x, *y, same)

    def leaf(self, i: int, j: int, k: int, m: int, same: bool) -> None:
        near = self.a32[i:j] @ self.b32[k:m].T
        linked = near >= self.least
        r, c = np.nonzero(np.abs(near - np.float32(self.least)) <= MARGIN)
        for s in range(0, len(r), 1 << 16):
            rr, cc = r[s : s + (1 << 16)], c[s : s + (1 << 16)]
            linked[rr, cc] = np.einsum("ij,ij->i", self.a[2][i + rr], self.b[2][k + cc]) >= self.least
        own = same and i == k
        if own:
            np.fill_diagonal(linked, False)
            linked &= linked.T
        if not linked.any():
            return
        self.na[i:j] += linked @ self.b[1][k:m]
        if not own:
            self.nb[k:m] += linked.T @ self.a[1][i:j]
        rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        part = linked[np.ix_(rows, cols)]
        ids_r, ids_c = self.a[0][i:j][rows], self.b[0][k:m][cols]
        top = np.iinfo(np.int64).max
        mark_r, mark_c = ids_r.copy(), ids_c.copy()
        while True:
            new_r = np.minimum(mark_r, np.where(part, mark_c[None, :], top).min(1))
            new_c = np.minimum(mark_c, np.where(part, new_r[:, None], top).min(0))
            if (new_r == mark_r).all() and (new_c == mark_c).all():
                break
            mark_r, mark_c = new_r, new_c
        for x, y in zip(ids_r.tolist() + ids_c.tolist(), mark_r.tolist() + mark_c.tolist(), strict=True):
            self.forest.join(x, y)


def _projected(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    return x @ axes[x.shape[1]] if x.shape[1] in axes else np.zeros((len(x), 1))


def _intervals(placed: DataFrame, axes: dict[int, np.ndarray], dtype: np.dtype) -> DataFrame:
    """One row per interval of neighbours in the order of dim, cells and id: name, dim, box, cells, ids, copies, vectors.

    placed: id, copies, dim, cells, raw (the vector's bytes). Places in the order come from the range partitions' counts
    (a row each), so intervals are full however many partitions there are. Within an interval vectors stay in order.
    """
    ordered = placed.repartitionByRange("dim", "cells", "id").sortWithinPartitions("dim", "cells", "id").withColumn("m", F.monotonically_increasing_id())
    ordered = cut(ordered.select("id", "copies", "dim", "cells", "raw", F.shiftright("m", 33).cast("int").alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("nth")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    full = F.greatest(F.lit(1), F.floor(F.lit(INTERVAL_BYTES) / F.length("raw")))
    dealt = ordered.join(starts, "part").withColumn("interval", F.floor((F.col("start") + F.col("nth")) / full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        last = None

        def flush() -> pa.RecordBatch:
            raw = np.stack([h[2] for h in held])
            p = _projected(unit(raw), axes)
            lo, hi = (np.pad(f(axis=0), (0, BOX_DIMS - p.shape[1])).tolist() for f in (p.min, p.max))
            ids, copies = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
            cells = sorted({tuple(h[3]) for h in held})
            held.clear()
            kinds = pa.schema([("name", pa.int64()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("cells", pa.list_(pa.list_(pa.int32()))), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())])
            row = {"name": int(ids[0]), "dim": raw.shape[1], "lo": lo, "hi": hi, "cells": cells, "ids": ids.tobytes(), "copies": copies.tobytes(), "vectors": raw.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=kinds)

        for b in batches:
            for i, n, v, c, k in zip(*(b.column(c).to_pylist() for c in ("id", "copies", "raw", "cells", "interval")), strict=True):
                v = np.frombuffer(v, dtype)
                if held and (k != last or len(held[0][2]) != len(v)):
                    yield flush()
                last = k
                held.append((i, n, v, c))
        if held:
            yield flush()

    rows = dealt.repartition("dim", "interval").sortWithinPartitions("dim", "interval", "cells", "id").select("id", "copies", "raw", "cells", "interval")
    return rows.mapInArrow(run, "name long, dim int, lo array<double>, hi array<double>, cells array<array<int>>, ids binary, copies binary, vectors binary")


def _neighbours(k: int):
    """A cell and its two neighbours in dimension k, as a function of a column."""

    def of(cell: Column) -> Column:
        moved = lambda x: F.concat(F.slice(cell, 1, k), F.array(x), F.slice(cell, k + 2, CELL_DIMS))
        here = F.get(cell, F.lit(k))
        return F.when(F.size(cell) <= k, F.array(cell)).otherwise(F.transform(F.sequence(here - 1, here + 1), moved))

    return of


def _meeting_pairs(intervals: DataFrame, eps: float) -> DataFrame:
    """(a, b, lo, hi), the box being a's: intervals with neighbouring cells whose boxes come within epsilon, a <= b."""
    boxes = intervals.select("name", "dim", "lo", "hi", "cells")
    around = F.col("cells")
    for k in range(CELL_DIMS):
        around = F.array_distinct(F.flatten(F.transform(around, _neighbours(k))))
    left = boxes.select(F.col("name").alias("a"), "dim", F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.explode(around).alias("cell"))
    right = boxes.select(F.col("name").alias("b"), "dim", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.explode("cells").alias("cell"))
    gaps = F.transform(F.sequence(F.lit(0), F.lit(BOX_DIMS - 1)), lambda k: F.greatest(F.lit(0.0), F.get("lo_a", k) - F.get("hi_b", k), F.get("lo_b", k) - F.get("hi_a", k)))
    close = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x * x) <= eps**2
    met = left.join(right, ["dim", "cell"]).where((F.col("a") <= F.col("b")) & close)
    return met.select("a", "b", F.col("lo_a").alias("lo"), F.col("hi_a").alias("hi")).dropDuplicates(["a", "b"])


def _visitors(pairs: DataFrame, intervals: DataFrame, axes: dict[int, np.ndarray], dtype: np.dtype, eps: float) -> DataFrame:
    """(a, ids_b, copies_b, vectors_b): what of b lies within epsilon of a's box, for the pairs of two intervals; nulls for a pair of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, known = None, ()
        for batch in batches:
            for k in range(len(batch)):
                a, b = batch.column("a")[k].as_py(), batch.column("b")[k].as_py()
                row = {"a": [a], "ids_b": [None], "copies_b": [None], "vectors_b": [None]}
                if a != b:
                    if b != name:
                        raw = np.frombuffer(batch.column("vectors")[k].as_py(), dtype).reshape(-1, batch.column("dim")[k].as_py())
                        ids, copies = (np.frombuffer(batch.column(c)[k].as_py(), np.int64) for c in ("ids", "copies"))
                        name, known = b, (raw, _projected(unit(raw), axes), ids, copies)
                    raw, p, ids, copies = known
                    lo, hi = (np.array(batch.column(c)[k].as_py())[: p.shape[1]] for c in ("lo", "hi"))
                    gap = np.maximum(0, np.maximum(lo - p, p - hi))
                    fit = (gap * gap).sum(axis=1) <= eps**2
                    if not fit.any():
                        continue
                    row = {"a": [a], "ids_b": [ids[fit].tobytes()], "copies_b": [copies[fit].tobytes()], "vectors_b": [raw[fit].tobytes()]}
                yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("a", pa.int64()), *((c, pa.binary()) for c in ("ids_b", "copies_b", "vectors_b"))]))

    b = intervals.select(F.col("name").alias("b"), "dim", "ids", "copies", "vectors")
    joined = pairs.join(b, "b").sortWithinPartitions("b").select("a", "b", "lo", "hi", "dim", "ids", "copies", "vectors")
    return joined.mapInArrow(run, "a long, ids_b binary, copies_b binary, vectors_b binary")


def embedding_dedup(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    kind = vectors.schema[vec_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    raw, dtype = (named(vec_col), np.dtype(np.float32)) if single else (named(vec_col).cast("array<double>"), np.dtype(np.float64))
    good = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(long_id(vectors, id_col).alias("id"), raw.alias("v")).withColumn("v", F.when(good, F.col("v")))
    distinct = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    sample = [np.array(r["v"]) for r in distinct.orderBy(F.xxhash64("v")).limit(SAMPLE).collect()]
    axes, eps = principal(sample), float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("id", pa.int64()), ("copies", pa.int64()), ("dim", pa.int32()), ("cells", pa.list_(pa.int32())), ("raw", pa.binary())])
        for b in batches:
            dims = [len(v) for v in b.column("v")]
            for dim in sorted(set(dims)):
                at = np.flatnonzero(np.array(dims) == dim)
                part = b.take(pa.array(at))
                v = np.array(part.column("v").to_pylist(), dtype)
                cells = np.floor((unit(v) @ axes[dim])[:, :CELL_DIMS] / eps).astype(int).tolist() if dim in axes else [[0]] * len(at)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copies"), pa.array([dim] * len(at), pa.int32()), pa.array(cells, kinds.field("cells").type), pa.array([x.tobytes() for x in v], pa.binary())], schema=kinds)

    placed = distinct.mapInArrow(place, "id long, copies long, dim int, cells array<int>, raw binary")
    intervals = cut(_intervals(placed, axes, dtype))
    pairs = cut(_meeting_pairs(intervals, eps))
    visits = _visitors(pairs, intervals, axes, dtype, eps)
    meetings = visits.join(intervals.select(F.col("name").alias("a"), "dim", "ids", "copies", "vectors"), "a").sortWithinPartitions("a")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def load(row: dict, end: str) -> tuple:
            x = unit(np.frombuffer(row[f"vectors{end}"], dtype).reshape(-1, row["dim"]))
            return np.frombuffer(row[f"ids{end}"], np.int64), np.frombuffer(row[f"copies{end}"], np.int64), x, _projected(x, axes)

        name, a = None, ()
        for batch in batches:
            for k in range(len(batch)):
                same = not batch.column("ids_b")[k].is_valid
                if batch.column("a")[k].as_py() != name:
                    name = batch.column("a")[k].as_py()
                    a = load({c: batch.column(c)[k].as_py() for c in ("dim", "ids", "copies", "vectors")}, "")
                b = a if same else load({c: batch.column(c)[k].as_py() for c in ("dim", "ids_b", "copies_b", "vectors_b")}, "_b")
                meeting = Meeting(least)
                na, nb = meeting.run(a, b, same)
                ids, n = (a[0], na + nb) if same else (np.concatenate([a[0], b[0]]), np.concatenate([na, nb]))
                hit = n > 0
                tops = [meeting.forest.top(x) for x in ids[hit].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(n[hit]), pa.array(tops, pa.int64())], names=["id", "n", "top"])

    found = cut(meetings.mapInArrow(meet, "id long, n long, top long"))
    for done in (pairs, intervals):
        drop_cut(done)
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("id").alias("a"), F.col("top").alias("b")))
    known = distinct.join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    return rows.join(known, "v", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("root", "id")).alias("kept"),
    )
