"""Line de-duplication within an edit bound by a deletion-neighbourhood join.

Lines are the texts' pieces between newlines; a line's words are its lower-cased (A-Z) runs of non-blanks, and lines
without words always stay. The bound is ``EDITS`` = 1 inserted, deleted or replaced word for lines of at least
``MIN_WORDS`` = 5 words (a similarity of 0.8), and none for shorter lines. A line goes if an earlier line of the
corpus, by id and then by place in the text, whether itself kept or not, lies within the bound; of repeats and
near repeats the earliest stays.

Deletion neighbourhood: a line's variants are the line itself and the line without one word, as hashed keys that
name the missing place. Lines that differ in one replaced word share a variant with the same place; a line with an
inserted word shares a variant with the shorter line itself. Aggregates take the earliest line of every key, so a
variant that very many lines share costs no more than others, and each line's match is verified by edit distance on the
words themselves.

Only lines that can have a match emit variants: within one edit, the first or the last half of the words agrees,
so a line whose halves occur nowhere else has none, and one that shares only its first half has its edit behind it.
This loses nothing and keeps the variants in proportion to the near repeats.

Defined cases: ids are integers, others are refused with a ValueError; null text has no lines; rows that repeat an id and a text are the same lines and share a decision; a
null id sorts before all others; the line that is removed goes with its newline; very long texts and lines are compared whole; of lines that tie in id and text all are the same line; an empty table gives an empty result;
other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, long_id, text_of, tidy
from .membership import split_by_key

EDITS, MIN_WORDS = 1, 5
FIRST, LAST = 1, 2
#: Seed of a line's second hash.
OTHER = 1 << 40
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def words_of(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").lower().split()


def hashed(words: list[bytes], seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(b"\n".join(words), seed)


def signed(keys: list[int]) -> pa.Array:
    return pa.array(np.array(keys, np.uint64).view(np.int64))


def half_keys(words: list[bytes]) -> list[int]:
    """Keys of the first and last halves that a line within one edit shares one of, in turn: of n words and of n and one more."""
    n = len(words)
    out = []
    for h in {n // 2, (n - 1) // 2}:
        out += (hashed(words[:h], 2 * h + FIRST), hashed(words[n - h :], 2 * h + LAST))
    return out


def sequence_hashes(words: list[bytes]) -> tuple[int, np.ndarray]:
    """The hash of a sequence of words, and of it without each of them: sums of word hashes times powers of a base."""
    n = len(words)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64) * powers[:n])])
    # What stands behind a missing word moves one place to the front.
    without = (sums[:-1] + (sums[-1] - sums[1:]) * INVERSE) ^ np.uint64(n - 1)
    return int(sums[-1]) ^ n, without


def variants(words: list[bytes], sides: int) -> tuple[np.ndarray, list[int]]:
    """Keys and places of the line itself (place -1) and of its deletions in the parts that a shared half leaves open."""
    n = len(words)
    low, high = (n - 1) // 2, n - (n - 1) // 2
    places = [i for i in range(n) if (sides & FIRST and i >= low) or (sides & LAST and i < high)]
    own, without = sequence_hashes(words)
    return np.concatenate([np.array([own], np.uint64), without[places]]).view(np.int64), [-1, *places]


def within(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one inserted, deleted or replaced word at most turns a into b: nothing else lies between what they share at both ends."""
    if abs(len(a) - len(b)) > EDITS:
        return False
    n, k = min(len(a), len(b)), 0
    while k < n and a[k] == b[k]:
        k += 1
    m = 0
    while m < n - k and a[-1 - m] == b[-1 - m]:
        m += 1
    return max(len(a), len(b)) - k - m <= EDITS


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(k1, k2, line, own, other, halves): the line's two hashes and, for long lines, its half keys, first and last in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, line, own, other, flat, ends = [], [], [], [], [], [0]
            for i in range(len(b)):
                for k, text in enumerate(b.column("text")[i].as_py().split("\n")):
                    words = words_of(text)
                    if words:
                        who.append(i)
                        line.append(k)
                        body = b"\n".join(words)
                        own.append(xxhash.xxh3_64_intdigest(body))
                        other.append(xxhash.xxh3_64_intdigest(body, OTHER))
                        if len(words) >= min_words:
                            flat += half_keys(words)
                        ends.append(len(flat))
                if len(who) > 50_000 or i + 1 == len(b):
                    at = pa.array(who, pa.int64())
                    halves = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(flat))
                    yield pa.RecordBatch.from_arrays([b.column("k1").take(at), b.column("k2").take(at), pa.array(line, pa.int32()), signed(own), signed(other), halves], names=["k1", "k2", "line", "own", "other", "halves"])
                    who, line, own, other, flat, ends = [], [], [], [], [], [0]

    return docs.select("k1", "k2", "text").mapInArrow(tidy(run), "k1 long, k2 long, line int, own long, other long, halves array<long>")


def _variants(docs: DataFrame) -> DataFrame:
    """docs with ``want``, [(line, sides, own, other)]: the lines' texts and variants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("line", pa.int32()), ("own", pa.int64()), ("other", pa.int64()), ("said", pa.string()), ("keys", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])
        for b in batches:
            for i in range(len(b)):
                lines = b.column("text")[i].as_py().split("\n")
                out: dict = {n: [] for n in kinds.names}
                for w in b.column("want")[i].as_py():
                    keys, places = variants(words_of(lines[w["line"]]), w["sides"])
                    row = (b.column("k1")[i].as_py(), b.column("k2")[i].as_py(), w["line"], w["own"], w["other"], lines[w["line"]], keys.tolist(), places)
                    for n, x in zip(kinds.names, row, strict=True):
                        out[n].append(x)
                yield pa.RecordBatch.from_pydict(out, schema=kinds)

    return docs.select("k1", "k2", "text", "want").mapInArrow(tidy(run), "k1 long, k2 long, line int, own long, other long, said string, keys array<long>, places array<int>")


def _near(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array([within(words_of(x), words_of(y)) for x, y in zip(b.column("said").to_pylist(), b.column("mate").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in ("own", "other")], names=["own", "other"])

    return pairs.select("own", "other", "said", "mate").mapInArrow(tidy(run), "own long, other long")


def removed_lines(keyed: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, gone): the places of the lines to remove in each text that has any. keyed: k1, k2, text."""
    lines = cut(_lines(keyed, min_words))
    place = F.struct("k1", "k2", "line")
    distinct = cut(lines.groupBy("own", "other").agg(F.min(place).alias("at"), F.first("halves").alias("halves")))
    halves = distinct.select("own", "other", F.posexplode("halves").alias("place", "key")).select("own", "other", "key", F.when(F.col("place") % 2 == 0, FIRST).otherwise(LAST).alias("side"))
    # The small sides of these joins are written first, so that a half or a deletion that very many lines share can be split.
    shared = cut(halves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    able = halves.join(shared, "key").groupBy("own", "other").agg(F.bit_or("side").alias("sides"))
    wanted = able.join(distinct.select("own", "other", "at"), ["own", "other"]).select("at.k1", "at.k2", F.struct("at.line", "sides", "own", "other").alias("w"))
    lists = cut(wanted.groupBy("k1", "k2").agg(F.collect_list("w").alias("want")))
    once = split_by_key(keyed, lists, ["k1", "k2"])[0].join(lists, ["k1", "k2"])
    made = cut(_variants(once).dropDuplicates(["own", "other"]))
    order = F.struct("k1", "k2", "line")
    keys = made.select(order.alias("at"), "own", "other", F.explode(F.arrays_zip("keys", "places")).alias("v")).select("at", "own", "other", F.col("v.keys").alias("key"), F.col("v.places").alias("place"))
    keys = cut(keys)
    # Replaced words: the earliest line of each deletion with its place.
    replaced = cut(keys.where("place >= 0").groupBy("key", "place").agg(F.min("at").alias("mate"), F.count("*").alias("n")).where("n > 1").drop("n"))
    by_place = keys.join(replaced, ["key", "place"]).where(F.col("mate") < F.col("at")).select("own", "other", "mate")
    # Inserted words: a deletion of the longer line is the shorter line itself, either of which may be earlier.
    longer = keys.where("place >= 0").groupBy("key").agg(F.min("at").alias("long"))
    shorter = keys.where("place < 0").select("key", F.col("at").alias("short"), F.col("own").alias("s_own"), F.col("other").alias("s_other"))
    met = cut(shorter.join(longer, "key"))
    late_short = met.where(F.col("long") < F.col("short")).select(F.col("s_own").alias("own"), F.col("s_other").alias("other"), F.col("long").alias("mate"))
    late_long = keys.where("place >= 0").join(met.select("key", "short"), "key").where(F.col("short") < F.col("at")).select("own", "other", F.col("short").alias("mate"))
    pairs = by_place.unionByName(late_short).unionByName(late_long).distinct()
    said = made.select("own", "other", "said")
    mates = made.select(F.struct("k1", "k2", "line").alias("mate"), F.col("said").alias("mate_said"))
    near = _near(pairs.join(mates, "mate").join(said, ["own", "other"]).select("own", "other", "said", F.col("mate_said").alias("mate"))).distinct()
    near = cut(near)
    firsts = distinct.join(near.withColumn("near", F.lit(True)), ["own", "other"], "left").select("own", "other", "at", F.coalesce("near", F.lit(False)).alias("near"))
    repeated = lines.groupBy("own", "other").agg(F.count("*").alias("n")).where("n > 1").select("own", "other")
    hot = firsts.join(repeated.withColumn("again", F.lit(True)), ["own", "other"], "left").where("near or again").select("own", "other", "at", "near")
    # Written first, so that the join reads two plain exchanges and a very common line can be split.
    hot = cut(hot)
    gone = lines.join(hot, ["own", "other"]).where(F.col("near") | (F.struct("k1", "k2", "line") != F.col("at")))
    out = cut(gone.groupBy("k1", "k2").agg(F.collect_set("line").alias("gone")))
    for df in (shared, replaced, keys, made, lists, lines, distinct, met, near, hot):
        drop_cut(df)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the lines removed from the text, and n_lines and n_removed (both of the text as it was).

    min_words: lines of fewer words have to be equal.
    """
    cols = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.coalesce(long_id(docs, id_col), F.lit(-(1 << 63))).alias("k1"), text_of(text_col).alias("text")).withColumn("k2", F.xxhash64("text"))
    gone = removed_lines(keyed, min_words)
    maybe, clean = split_by_key(keyed, gone, ["k1", "k2"])
    both = maybe.join(gone, ["k1", "k2"], "left").unionByName(clean.withColumn("gone", F.lit(None).cast("array<int>")))
    lines = F.split("text", "\n", -1)
    left = F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: ~F.array_contains("gone", p["i"])), lambda p: p["x"])
    text = F.when(F.col("gone").isNull(), F.col("row")[text_col].cast("string")).otherwise(F.array_join(left, "\n"))
    shown = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in cols]
    n_lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(lines)).cast("long")
    return both.select(*shown, n_lines.alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))
