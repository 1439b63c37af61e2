"""Repeated byte strings by suffix order up to a fixed length.

A byte is repeated if it lies in a string of ``length`` bytes that also starts somewhere else. All such strings of the
corpus are found without one suffix array over it:

1. Each window of ``length`` bytes picks the smallest hash among its substrings of ``GRAM`` bytes. Equal windows pick
   equal anchors, so repeats only need to be looked for among windows of one anchor. Neighbouring windows share their
   anchor: an occurrence is a run of windows with its text, the context. Anchors that occur once are dropped.
2. Equal contexts of an anchor are merged with a count; the windows of a merged context are repeated at once. Equal here
   means 128 bits of two hashes, of the anchor and of the context; only distinct contexts move their bytes.
3. The distinct contexts of an anchor meet in one task. Prefix doubling over their joined bytes gives the suffix order;
   the previous and next smaller positions in it give each position's longest previous factor, which is computed up to
   ``length``. Positions whose factor reaches ``length``, and the earlier positions that it is a copy of, are repeated.
4. An anchor with more than ``CROWD`` distinct contexts would make an unbounded task. Its contexts are cut into blocks of
   ``BLOCK`` windows, aligned at the anchor; the bytes that all windows of a block share are an anchor of their own, and
   steps 1 to 3 run again on the blocks. What is still crowded then is hashed window by window (128 bits) and counted by
   an aggregate, which is exact and combines before the shuffle.

Repeated windows go back to every occurrence of their context and are united per document. ``keep="none"`` removes
every repeated byte, ``keep="first"`` leaves the first copy (by id, then position) of each repeated string.

Defined cases: ids are integers, others are refused with a ValueError; null text is empty; texts shorter than ``length`` have no repeats; rows that repeat an id are documents
of their own, so equal rows repeat each other, and ``keep="first"`` leaves one of them; matches never cross documents; documents may be of any length; a
null id is an id of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, long_id, named, text_of
from .membership import split_by_key

LENGTH, GRAM, CROWD, JOINED, SEGMENT = 400, 64, 256, 1 << 20, 1 << 23
BLOCK = 32
_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE2 = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, as many as the longest text has needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            m = max(n + 1, 1 << 16)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m, BASE)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m, INVERSE)]))
        return self.up, self.down


class Hashes:
    """Polynomial hashes of all substrings of a text."""

    def __init__(self, data: np.ndarray, powers: Powers, table: np.ndarray = BYTE):
        self.up, down = powers(len(data) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(table[data] * down[: len(data)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.up[start] ^ (end - start).astype(np.uint64))

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.up[:n])


def contexts(data: np.ndarray, powers: Powers, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window, number of windows) of each run of windows with one anchor."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    if n > SEGMENT:
        parts = [(s, contexts(data[s : s + SEGMENT + length - 1], powers, length)) for s in range(0, n, SEGMENT)]
        return tuple(np.concatenate([p[k] + s if k == 2 else p[k] for s, p in parts]) for k in range(4))
    h = Hashes(data, powers)
    grams, w = h.all(GRAM), length - GRAM + 1
    # Windows compare 40 bits of hash, then the place, so that the leftmost of equal hashes is picked.
    rank = mixed(grams + BASE)
    key = (rank & ~np.uint64(0xFFFFFF)) | (np.arange(len(grams), dtype=np.uint64) & np.uint64(0xFFFFFF))
    padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    block = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    counts = np.diff(np.append(starts, n))
    at = (low[starts] & np.uint64(0xFFFFFF)).astype(np.int64)
    return grams[at], h.of(starts, starts + counts - 1 + length) ^ mixed((at - starts).astype(np.uint64)), starts, counts


def stable_order(keys: np.ndarray) -> np.ndarray:
    """The order of keys under 2**32, ties as they stand, by radix passes of 16 bits."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    if len(keys) and keys.max() >> 16:
        order = order[np.argsort((keys[order] >> 16).astype(np.uint16), kind="stable")]
    return order


class Suffixes:
    """The suffixes of joined texts in the order of their next ``length`` bytes, by prefix doubling.

    levels: (h, rank of the next h bytes at every position; equal strings, equal ranks) for h = 8, 16, ... and ``length``.
    """

    def __init__(self, data: np.ndarray, length: int):
        n, self.length = len(data), length
        wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        self.word = np.zeros(n, np.uint64)
        for j in range(8):
            self.word = self.word << np.uint64(8) | wide[j : j + n]
        order = np.arange(n)
        for low in (0, 32):
            order = order[stable_order((self.word[order] >> np.uint64(low) & np.uint64(0xFFFFFFFF)).astype(np.int64))]
        ordered = self.word[order]
        rank, h = self._numbered(order, ordered[1:] != ordered[:-1]), 8
        self.levels = [(h, rank)]
        while h < length:
            step = min(h, length - h)
            # The order by what follows is known; a stable sort by what is in front makes it the order by both.
            behind = np.concatenate([np.arange(max(0, n - step), n), order[order >= step] - step])
            order = behind[stable_order(rank[behind])]
            front, rest = rank[order], np.append(rank, np.full(step, -1, np.int32))[order + step]
            rank, h = self._numbered(order, (front[1:] != front[:-1]) | (rest[1:] != rest[:-1])), h + step
            self.levels.append((h, rank))

    @staticmethod
    def _numbered(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int32)
        rank[order] = np.cumsum(np.concatenate([[0], new]))
        return rank

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The longest common prefix of the suffixes at x and y, ``length`` at most."""
        out = np.zeros(len(x), np.int64)
        for h, rank in reversed(self.levels):
            at = np.flatnonzero(out + h <= self.length)
            same = at[rank[x[at] + out[at]] == rank[y[at] + out[at]]]
            out[same] += h
        rest = np.flatnonzero(out < self.length)
        differ = self.word[x[rest] + out[rest]] ^ self.word[y[rest] + out[rest]]
        for j in range(7, 0, -1):
            out[rest] += differ >> np.uint64(8 * j) == 0
        out[rest] = np.minimum(out[rest], self.length - 1)
        return out


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place of a list of distinct numbers, the nearest place before it with a smaller one, or -1, by pointer jumping."""
    near = np.arange(-1, len(values) - 1)
    ended = np.append(values, -1)
    open_ = np.flatnonzero(ended[near] > values)
    while len(open_):
        near[open_] = near[near[open_]]
        open_ = open_[ended[near[open_]] > values[open_]]
    return near


def longest_previous_factors(data: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, sources) of all positions: the longest match of a valid position that begins at an earlier valid one.

    In suffix order (equal strings by position) the earlier positions nearest to a suffix on either side are its previous
    and next smaller ones; the longer of the two common prefixes, ``length`` at most, is its longest previous factor.
    """
    suffixes = Suffixes(data, length)
    where = np.flatnonzero(valid)
    order = where[stable_order(suffixes.levels[-1][1][where])]
    lengths, sources = np.zeros(len(data), np.int64), np.full(len(data), -1, np.int64)
    before = nearest_smaller(order)
    after = len(order) - 1 - nearest_smaller(order[::-1])[::-1]
    for near, has in ((before, before >= 0), (after, after < len(order))):
        mine, other = order[has], order[near[has]]
        got = suffixes.common(mine, other)
        longer = got > lengths[mine]
        lengths[mine[longer]], sources[mine[longer]] = got[longer], other[longer]
    return lengths, sources


def runs(flags: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of true values."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)


def repeated_windows(texts: list[bytes], counts: list[int], length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context, the windows that are repeated in the list and those of them with an earlier match in it.

    counts: how many windows of each text count; the longest previous factors are those of the joined texts.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    valid = np.zeros(len(data), bool)
    for end, text, n in zip(ends, texts, counts, strict=True):
        valid[end - len(text) : end - len(text) + n] = True
    factors, sources = longest_previous_factors(data, valid, length)
    later = factors >= length
    seen = later.copy()
    seen[sources[later]] = True
    return [(seen[e - len(t) : e - len(t) + n], later[e - len(t) : e - len(t) + n]) for e, t, n in zip(ends, texts, counts, strict=True)]


_OCC = "k1 long, k2 long, anchor long, ctx long, lo int, n int"


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """One row per run of windows: document key (k1, k2), anchor, context hash, first window, number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            parts, who = [], []
            for i, t in enumerate(b.column("bytes")):
                got = contexts(np.frombuffer(t.as_py(), np.uint8), powers, length)
                parts.append(got)
                who.append(np.full(len(got[0]), i))
                if sum(map(len, who)) > 100_000 or i + 1 == len(b):
                    who_ = pa.array(np.concatenate(who))
                    a, c, lo, n = (np.concatenate([p[k] for p in parts]) for k in range(4))
                    cols = [b.column("k1").take(who_), b.column("k2").take(who_), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["k1", "k2", "anchor", "ctx", "lo", "n"])
                    parts, who = [], []

    return docs.select("k1", "k2", "bytes").mapInArrow(run, _OCC)


def texts_of(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """wanted (k1, k2, lo, n, anchor, ctx, crowded) with the context's bytes; once for each row that repeats an id and text."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "n", "anchor", "ctx", "crowded")).alias("want"))
    joined = split_by_key(docs, lists, ["k1", "k2"])[0].join(lists, ["k1", "k2"])
    piece = lambda w: w.withField("piece", F.substring("bytes", w["lo"] + 1, w["n"] + (length - 1)))
    return joined.select("k1", "k2", F.explode(F.transform("want", piece)).alias("p")).select("k1", "k2", "p.*")


def match_contexts(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, ctx, seen, later): runs of the repeated windows among the distinct contexts of each anchor, and of those with an earlier match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            found = repeated_windows([h[2] for h in held], [h[3] for h in held], length)
            out = [(h[0], h[1], runs(seen), runs(later)) for h, (seen, later) in zip(held, found, strict=True) if seen.any()]
            held.clear()
            sides = [pa.array([o[k].astype(np.int32).tobytes() for o in out], pa.binary()) for k in (2, 3)]
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), *sides], names=["anchor", "ctx", "seen", "later"])

        for b in batches:
            for i in range(len(b)):
                anchor = b.column("anchor")[i].as_py()
                if size > JOINED and anchor != last:
                    yield flush()
                    size = 0
                last, ctx = anchor, b.column("ctx")[i].as_py()
                if held and held[-1][:2] == (anchor, ctx):
                    continue
                piece = b.column("piece")[i].as_py()
                held.append((anchor, ctx, piece, b.column("n")[i].as_py()))
                size += len(piece)
        if held:
            yield flush()

    return texts.repartition("anchor").sortWithinPartitions("anchor", "k1", "k2", "lo").mapInArrow(run, "anchor long, ctx long, seen binary, later binary")


def count_windows(texts: DataFrame, length: int) -> DataFrame:
    """The same for crowds: windows hashed twice and counted by an aggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            for i in range(len(b)):
                data = np.frombuffer(b.column("piece")[i].as_py(), np.uint8)
                n = len(data) - length + 1
                same = [pa.repeat(b.column(c)[i], n) for c in ("anchor", "ctx", "k1", "k2")]
                both = [pa.array(Hashes(data, powers, t).all(length).view(np.int64)) for t in (BYTE, BYTE2)]
                at = np.arange(n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*same, *both, pa.array(at + b.column("lo")[i].as_py()), pa.array(at)], names=["anchor", "ctx", "k1", "k2", "w1", "w2", "place", "at"])

    once = texts.dropDuplicates(["anchor", "ctx"])
    windows = cut(once.mapInArrow(run, "anchor long, ctx long, k1 long, k2 long, w1 long, w2 long, place int, at int"))
    many = windows.groupBy("w1", "w2").agg(F.count("*").alias("times"), F.min(F.struct("k1", "k2", "place")).alias("first")).where("times > 1").drop("times")
    # Written first, so that the join reads two plain exchanges and a hot window can be split.
    many = cut(many)
    later = F.struct("k1", "k2", "place") != F.col("first")
    hit = windows.join(many, ["w1", "w2"]).groupBy("anchor", "ctx").agg(F.collect_list(F.struct("at", later.alias("later"))).alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides: tuple[list, list] = ([], [])
            for at in b.column("at").to_pylist():
                for side, chosen in zip(sides, ([x["at"] for x in at], [x["at"] for x in at if x["later"]]), strict=True):
                    flags = np.zeros(max(chosen, default=-1) + 1, bool)
                    flags[chosen] = True
                    side.append(runs(flags).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("anchor"), b.column("ctx"), *(pa.array(x, pa.binary()) for x in sides)], names=["anchor", "ctx", "seen", "later"])

    return hit.mapInArrow(pack, "anchor long, ctx long, seen binary, later binary")


def split_crowds(texts: DataFrame, length: int) -> DataFrame:
    """The same for crowded anchors: blocks of windows under anchors of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            for i in range(len(b)):
                data, anchor = np.frombuffer(b.column("piece")[i].as_py(), np.uint8), b.column("anchor")[i].as_py()
                n, h = len(data) - length + 1, Hashes(data, powers)
                at = n - 1 + int(np.argmax(h.all(GRAM)[n - 1 :].view(np.int64) == anchor))
                block = (at - np.arange(n)) // BLOCK
                starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                ends, low = np.append(starts[1:], n), at - block[starts] * BLOCK
                core = h.of(low, low - BLOCK + 1 + length) ^ mixed(block[starts].astype(np.uint64) ^ np.uint64(anchor % (1 << 64)))
                whole = h.of(starts, ends - 1 + length) ^ mixed((at - starts).astype(np.uint64))
                up = [pa.repeat(b.column(c)[i], len(starts)) for c in ("anchor", "ctx", "k1", "k2")]
                own = [pa.array((starts + b.column("lo")[i].as_py()).astype(np.int32)), pa.array((ends - starts).astype(np.int32)), pa.array(mixed(core).view(np.int64)), pa.array(whole.view(np.int64)), pa.array(starts.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*up, *own], names=["up", "over", "k1", "k2", "lo", "n", "anchor", "ctx", "start"])

    once = cut(texts.dropDuplicates(["anchor", "ctx"]))
    blocks = cut(once.mapInArrow(run, "up long, over long, k1 long, k2 long, lo int, n int, anchor long, ctx long, start int"))
    here = shared_only(blocks)
    origin = once.select(F.col("anchor").alias("up"), F.col("ctx").alias("over"), F.col("piece").alias("all"))

    def pieces(wanted: DataFrame) -> DataFrame:
        from_ = here.select("anchor", "ctx", "k1", "k2", "lo", "up", "over", "start")
        found = wanted.join(from_, ["anchor", "ctx", "k1", "k2", "lo"]).join(origin, ["up", "over"])
        return found.select(*wanted.columns, F.substring("all", F.col("start") + 1, F.col("n") + (length - 1)).alias("piece"))

    known = resolve(here, pieces, length, deep=True)
    first = (F.struct("k1", "k2", "lo") == F.col("rep")).alias("first")
    hit = here.join(known, ["anchor", "ctx"]).groupBy("up", "over").agg(F.collect_list(F.struct("start", "n", "copies", first, "seen", "later")).alias("hits"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides: tuple[list, list] = ([], [])
            for hits in b.column("hits").to_pylist():
                flags = np.zeros((2, max(x["start"] + x["n"] for x in hits)), bool)
                for x in hits:
                    for side in (0, 1):
                        if x["copies"] > 1 and not (side and x["first"]):
                            flags[side, x["start"] : x["start"] + x["n"]] = True
                        else:
                            for lo, hi in np.frombuffer(x["later" if side else "seen"] or b"", np.int32).reshape(-1, 2):
                                flags[side, x["start"] + lo : x["start"] + hi] = True
                for side in (0, 1):
                    sides[side].append(runs(flags[side]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("up"), b.column("over"), *(pa.array(x, pa.binary()) for x in sides)], names=["anchor", "ctx", "seen", "later"])

    return hit.mapInArrow(pack, "anchor long, ctx long, seen binary, later binary")


def shared_only(found: DataFrame) -> DataFrame:
    """Occurrences of anchors that occur more than once, with ``single``: all of them have one context."""
    stats = found.groupBy("anchor").agg(F.count("*").alias("all"), F.min("ctx").alias("lo_ctx"), F.max("ctx").alias("hi_ctx")).where("all > 1")
    # Written first, so that the join reads two plain exchanges and a hot anchor can be split.
    return cut(found.join(cut(stats.select("anchor", (F.col("lo_ctx") == F.col("hi_ctx")).alias("single"))), "anchor"))


def resolve(here: DataFrame, pieces, length: int, deep: bool = False) -> DataFrame:
    """(anchor, ctx, copies, rep, seen, later) of the contexts with repeated windows; pieces adds the bytes of given occurrences."""
    first = F.struct(F.min(F.struct("k1", "k2", "lo")).alias("at"), F.min("n").alias("n"), F.count("*").alias("copies"))
    merged = cut(here.groupBy("anchor", "ctx", "single").agg(first.alias("m")).select("anchor", "ctx", "single", "m.at.k1", "m.at.k2", "m.at.lo", "m.n", "m.copies"))
    several = merged.where("not single")
    crowd = several.groupBy("anchor").agg(F.count("*").alias("contexts")).select("anchor", (F.col("contexts") > CROWD).alias("crowded"))
    texts = cut(pieces(several.join(cut(crowd), "anchor")))
    matched = match_contexts(texts.where("not crowded"), length)
    crowded = texts.where("crowded")
    if not crowded.isEmpty():
        matched = matched.unionByName(count_windows(crowded, length) if deep else split_crowds(crowded, length))
    known = merged.select("anchor", "ctx", "copies", F.struct("k1", "k2", "lo").alias("rep")).join(matched, ["anchor", "ctx"], "left")
    return cut(known.where("copies > 1 or seen is not null"))


def _without_copies(keyed: DataFrame, length: int) -> tuple[DataFrame, DataFrame | None]:
    """keyed with one row of those that are equal in id and text, and the results of the others: all their bytes go."""
    long = F.length("bytes") >= length
    twice = cut(keyed.where(long).groupBy("id", "k2").agg(F.count("*").alias("rows"), F.min(F.length("bytes")).alias("n")).where("rows > 1"))
    if twice.isEmpty():
        return keyed, None
    again, once = split_by_key(keyed.where(long), twice, ["id", "k2"])
    left = keyed.where(~long).unionByName(once).unionByName(cut(again.dropDuplicates(["id", "k2"])))
    n = F.col("n").cast("long")
    spans = F.array(F.array(F.lit(0).cast("long"), n)).alias("spans")
    rest = twice.select("id", "n", F.explode(F.sequence(F.lit(2).cast("long"), F.col("rows"))))
    return left, rest.select("id", F.lit(b"").alias("kept"), spans, n.alias("n_bytes"), n.alias("n_removed"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, keep: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, kept (the text's remaining bytes), spans [(start, end)] removed, n_bytes, n_removed, n_spans."""
    if keep not in ("first", "none"):
        raise ValueError(f"keep is first or none, not {keep}")
    long_id(docs, id_col)
    keyed = docs.select(named(id_col).alias("id"), text_of(text_col).alias("t")).select("id", F.coalesce(F.col("id").cast("long"), F.lit(-1)).alias("k1"), F.xxhash64("t").alias("k2"), F.encode("t", "UTF-8").alias("bytes"))
    keyed, copies = (keyed, None) if keep == "none" else _without_copies(keyed, length)
    found = cut(occurrences(keyed.where(F.length("bytes") >= length), length))
    here = shared_only(found)
    drop_cut(found)
    known = resolve(here, lambda wanted: texts_of(wanted, keyed, length), length)
    copy = F.struct("k1", "k2", "lo") != F.col("rep")
    # The runs of an occurrence's repeated windows; null stands for all of them.
    chosen = F.when(F.col("copies") > 1, F.lit(None)).otherwise(F.col("seen")) if keep == "none" else F.when(copy, F.lit(None)).otherwise(F.coalesce("later", F.lit(b"")))
    hits = here.join(known, ["anchor", "ctx"]).select("k1", "k2", "lo", "n", chosen.alias("runs")).where("runs is null or length(runs) > 0")
    per_doc = cut(hits.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "n", "runs")).alias("hits")))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                data = np.frombuffer(b.column("bytes")[i].as_py(), np.uint8)
                edge = np.zeros(len(data) + 1, np.int32)
                for h in b.column("hits")[i].as_py():
                    parts = np.array([[0, h["n"]]]) if h["runs"] is None else np.frombuffer(h["runs"], np.int32).reshape(-1, 2)
                    np.add.at(edge, h["lo"] + parts[:, 0], 1)
                    np.add.at(edge, h["lo"] + parts[:, 1] - 1 + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                cuts = runs(gone)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(i, 1), pa.array([data[~gone].tobytes()], pa.binary()), pa.array([cuts.tolist()], pa.list_(pa.list_(pa.int64()))), pa.array([len(data)], pa.int64()), pa.array([int(gone.sum())], pa.int64())],
                    names=["id", "kept", "spans", "n_bytes", "n_removed"],
                )

    maybe, clean = split_by_key(keyed, per_doc, ["k1", "k2"])
    kind = keyed.schema["id"].dataType.simpleString()
    none = F.lit(None).cast("array<array<bigint>>")
    both = maybe.join(per_doc, ["k1", "k2"], "left")
    touched = both.where("hits is not null").select("id", "bytes", "hits").mapInArrow(remove, f"id {kind}, kept binary, spans array<array<bigint>>, n_bytes long, n_removed long")
    plain = lambda d: d.select("id", F.col("bytes").alias("kept"), F.coalesce(none, F.array().cast("array<array<bigint>>")).alias("spans"), F.length("bytes").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"))
    done = touched.unionByName(plain(both.where("hits is null"))).unionByName(plain(clean))
    if copies is not None:
        done = done.unionByName(copies)
    return done.select(F.col("id").alias(id_col), "kept", "spans", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"))
