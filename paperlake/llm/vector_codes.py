"""Vector code compression: product codes whose codebooks are learned by Yinyang Lloyd, exact in integers.

Each component x counts as the integer floor(scale * x). Vectors are cut into equal consecutive parts; a part position's
codebook starts as that part of the vectors with the smallest ids. A round of Lloyd gives every part to its nearest
entry, ties to the lower index, and moves each entry to the floor of the mean of its parts; unused entries stay.

Yinyang: a codebook's entries are clustered into groups once. Each part of a vector keeps an upper bound of the distance
to its entry and one lower bound per group for the distances to the group's other entries. When entries move, the
upper bound grows by the entry's drift and a lower bound shrinks by the largest drift in its group. A part whose upper
bound is below all lower bounds keeps its entry; else the upper bound is made exact and only groups that still fail
are scanned. Bounds are rounded to their safe side, and whatever a bound does not exclude is decided on integers:
squared distances are sums of products of integers, taken in doubles while these hold all of them exactly and in
64-bit integers otherwise, so ties are real ties.

On Spark a round is one pass of tasks over the vectors and their bounds, written as the next table, and one over the
codes for the sums. Vectors never move between tasks; each task sends one partial sum per entry, and the driver
keeps the codebooks alone (``parts * entries`` vectors of a part's width).

Defined cases: vectors that are null or hold null or non-finite components are dropped; a null id comes after all
others, and vectors of equal ids are in the order of their bytes; repeated rows are rows of their own; shorter vectors
count as filled with zeros up to the longest one's length, which is itself rounded up to a multiple of ``parts``; components
whose squares could leave 64 bits are held at the largest that cannot (185,363.8 for 64 components at scale 1024); an
empty table gives an empty result; a table of fewer vectors than entries has smaller codebooks; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, named

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries that share a lower bound, on average.
GROUP = 16
#: Rows whose distances are computed at once, and columns of a partial sum's row.
SLAB, BLOCK = 4096, 16
#: The sides on which bounds are rounded.
UP, DOWN = 1 + 1e-9, 1 - 1e-6


@dataclass
class Compressed:
    codes: DataFrame
    """id, label, codes (array of indexes), error, label_error."""
    codebooks: np.ndarray
    """Integers by part, entry and position within the part."""

    def spelled(self) -> str:
        return ",".join(map(str, self.codebooks.ravel().tolist()))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows x (n, w) to integer rows c (k, w)."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, entry in enumerate(c):
        out[:, j] = ((x - entry) ** 2).sum(1)
    return out


def to_own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows x to the rows of c at the same places."""
    return ((x - c) ** 2).sum(1)


def grouped(book: np.ndarray) -> np.ndarray:
    """A group for each entry: some rounds of Lloyd over the entries; decides what is scanned, never a result."""
    k = len(book)
    at = np.arange(k) * max(1, k // GROUP) // max(1, k)
    x = book.astype(np.float64)
    for _ in range(5):
        used = np.unique(at)
        centres = np.stack([x[at == g].mean(0) for g in used]) if k else x
        at = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1) if k else at
    return np.unique(at, return_inverse=True)[1] if k else at


class Bounds:
    """One part position's assignment of a batch of vectors, with their bounds."""

    def __init__(self, book: np.ndarray, groups: np.ndarray):
        self.book, self.groups = book, groups
        self.members = [np.flatnonzero(groups == g) for g in range(int(groups.max(initial=-1)) + 1)]

    def nearest(self, x: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a group's entries: the least squared distance, its lowest entry and the least distance to the others."""
        d = squared(x, self.book[self.members[group]])
        first = d.argmin(1)
        rows = np.arange(len(x))
        least = d[rows, first]
        rest = d.astype(np.float64)
        rest[rows, first] = np.inf
        return least, self.members[group][first], np.sqrt(rest.min(1))

    def scan(self, x, entry, upper, lower, wanted) -> None:
        """Scan the wanted (row, group) pairs; entry, upper and lower are replaced in place. Rows: squared distance to the entry in ``upper``."""
        before, before_d = entry.copy(), upper.copy()
        best, best_d = entry.copy(), upper.copy()
        seen = []
        for g in range(len(self.members)):
            rows = np.flatnonzero(wanted[:, g])
            if not len(rows):
                continue
            least, which, others = self.nearest(x[rows], g)
            seen.append((g, rows, least, which, others))
            # Integers decide: nearer, or as near with a lower index.
            better = (least < best_d[rows]) | ((least == best_d[rows]) & (which < best[rows]))
            best[rows[better]], best_d[rows[better]] = which[better], least[better]
        for g, rows, least, which, others in seen:
            lower[rows, g] = np.where(best[rows] == which, others, np.sqrt(least)) * DOWN
        left = np.flatnonzero((best != before) & (before >= 0))
        if len(left):
            g = self.groups[before[left]]
            unseen = ~wanted[left, g]
            at, of = left[unseen], g[unseen]
            lower[at, of] = np.minimum(lower[at, of], np.sqrt(before_d[at]) * DOWN)
        entry[:], upper[:] = best, best_d

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, squared distance, lower bounds) by a scan of all groups."""
        entry, near = np.full(len(x), -1), np.full(len(x), np.iinfo(np.int64).max)
        lower = np.zeros((len(x), len(self.members)))
        self.scan(x, entry, near, lower, np.ones(lower.shape, bool))
        return entry, near, lower

    def again(self, x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, upper bound, lower bounds) after the entries have moved by drift."""
        moved = np.array([drift[m].max() for m in self.members])
        upper, lower = upper + drift[entry], np.maximum(0, lower - moved) * DOWN
        fails = np.flatnonzero(upper * UP >= lower.min(1))
        if len(fails):
            part = x[fails]
            mine, low = entry[fails], lower[fails]
            near = to_own(part, self.book[mine])
            wanted = np.sqrt(near)[:, None] * UP >= low
            self.scan(part, mine, near, low, wanted)
            entry[fails], upper[fails], lower[fails] = mine, np.sqrt(near) * UP, low
        return entry, upper, lower


def _widths(n: int, parts: int) -> tuple[int, int]:
    """(width of a part, largest component) for vectors of up to n components."""
    width = max(1, -(-n // parts))
    return width, math.isqrt((1 << 61) // (width * parts)) - 1


def _quantised(vectors: DataFrame, names: tuple[str, str, str | None], parts: int, scale: int) -> tuple[DataFrame, int]:
    """(id, label, q): integers as 32-bit bytes; the width of a part."""
    ident, vec, label = names
    v = named(vec).cast("array<double>")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(named(ident).alias("id"), (named(label) if label else F.lit(None).cast("int")).alias("label"), v.alias("v")).where(F.col("v").isNotNull() & whole)
    width, top = _widths(rows.agg(F.max(F.size("v"))).first()[0] or 0, parts)
    full = width * parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sizes = np.diff(ends)
            q = np.zeros((len(b), full), np.int32)
            at = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)
            q[np.repeat(np.arange(len(b)), sizes), at] = np.clip(np.floor(scale * flat), -top, top)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([x.tobytes() for x in q], pa.binary())], names=["id", "label", "q"])

    kinds = dict(rows.dtypes)
    return cut(rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, q binary")), width


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(rows)], pa.binary())


def _assigned(state: DataFrame, books: np.ndarray, groups: list[np.ndarray], drift: np.ndarray | None, last: bool) -> DataFrame:
    """state with entries and bounds for these codebooks; in the end (id, label, codes, error). drift: None in the first pass."""
    parts, _, width = books.shape
    counts = [int(g.max(initial=-1)) + 1 for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [Bounds(books[p], groups[p]) for p in range(parts)]
        for whole in batches:
            for s in range(0, len(whole), SLAB):
                b = whole.slice(s, SLAB)
                q = _matrix(b.column("q"), np.int32, parts * width).astype(np.int64)
                entries, uppers, lowers, near = [], [], [], np.zeros(len(b), np.int64)
                if drift is not None:
                    old = _matrix(b.column("entry"), np.int32, parts)
                    above = _matrix(b.column("upper"), np.float64, parts)
                    below = _matrix(b.column("lower"), np.float32, sum(counts))
                for p, side in enumerate(sides):
                    x = q[:, p * width : (p + 1) * width]
                    if drift is None:
                        entry, d, lower = side.first(x)
                        upper = np.sqrt(d) * UP
                    else:
                        i = sum(counts[:p])
                        entry, upper, lower = side.again(x, old[:, p].astype(np.int64), above[:, p].copy(), below[:, i : i + counts[p]].astype(np.float64), drift[p])
                    if last:
                        near += to_own(x, books[p][entry])
                    entries.append(entry)
                    uppers.append(upper)
                    lowers.append(lower)
                entry = np.stack(entries, 1).astype(np.int32)
                if last:
                    codes = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * parts), pa.array(entry.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), codes, pa.array(near)], names=["id", "label", "codes", "error"])
                else:
                    bounds = _packed(np.stack(uppers, 1)), _packed((np.concatenate(lowers, 1) * DOWN).astype(np.float32))
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("q"), _packed(entry), *bounds], names=["id", "label", "q", "entry", "upper", "lower"])

    kinds = dict(state.dtypes)
    head = f"id {kinds['id']}, label {kinds['label']}"
    return state.mapInArrow(run, f"{head}, codes array<int>, error long" if last else f"{head}, q binary, entry binary, upper binary, lower binary")


def _moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with every used entry at the floor of its parts' mean."""
    parts, size, width = books.shape
    blocks = -(-width // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, blocks * BLOCK), np.int64)
        for b in batches:
            q = _matrix(b.column("q"), np.int32, parts * width)
            entry = _matrix(b.column("entry"), np.int32, parts)
            for p in range(parts):
                n[p] += np.bincount(entry[:, p], minlength=size)
                np.add.at(sums[p, :, :width], entry[:, p], q[:, p * width : (p + 1) * width].astype(np.int64))
        p, e = np.nonzero(n)
        at = np.repeat(np.arange(len(p)), blocks)
        values = sums[p, e].reshape(-1, BLOCK)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * BLOCK), pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x.astype(np.int32)) for x in (p[at], e[at], np.tile(np.arange(blocks), len(p)))), pa.array(n[p, e][at]), lists], names=["part", "entry", "block", "n", "sums"]
        )

    partial = state.select("q", "entry").mapInArrow(run, "part int, entry int, block int, n long, sums array<long>")
    whole = [F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(BLOCK)]
    out = books.copy()
    for r in partial.groupBy("part", "entry", "block").agg(F.sum("n").alias("n"), *whole).collect():
        here = out[r["part"], r["entry"], r["block"] * BLOCK : (r["block"] + 1) * BLOCK]
        here[:] = [int(r[f"s{k}"]) // r["n"] for k in range(len(here))]
    return out


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label"
) -> Compressed:
    """Codebooks after the given rounds, and every vector's codes, error and the error summed over its label (null past 64 bits)."""
    state, width = _quantised(vectors, (id_col, vec_col, label_col), parts, scale)
    first = state.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()
    books = np.stack([np.frombuffer(r["q"], np.int32) for r in first]).astype(np.int64) if first else np.zeros((0, parts * width), np.int64)
    books = np.ascontiguousarray(books.reshape(len(first), parts, width).transpose(1, 0, 2))
    groups, drift = [grouped(b) for b in books], None
    for _ in range(rounds if first else 0):
        after = cut(_assigned(state, books, groups, drift, last=False))
        drop_cut(state)
        state, before = after, books
        books = _moved(state, before)
        drift = np.sqrt(((books - before).astype(np.float64) ** 2).sum(2)) * UP
    done = cut(_assigned(state, books, groups, drift, last=True))
    drop_cut(state)
    # Written first, so that the join reads two plain exchanges and a hot label can be split.
    of_label = cut(done.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "mate"))
    return Compressed(done.join(of_label, F.col("label").eqNullSafe(F.col("mate"))).drop("mate"), books)


def hexadecimal(codes: Column, digits: int = 2) -> Column:
    """Codes in part order, so many lowercase hex digits each."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), digits, "0")), "")
