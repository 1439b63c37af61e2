"""Near-duplicate documents by SuperMinHash, banding, verification and union-find grouping.

A document's set holds its distinct shingles of ``k`` words (lower-cased A-Z, split at ASCII white space); with fewer
words the whole sequence is the one shingle. SuperMinHash gives every element one random rank in each round and a
place from the element's own permutation of the signature, so that ranks of round j lie in [j, j + 1); a document
stops as soon as no later round can lower a place. Permutations are Fisher-Yates shuffles, of which only the steps
that are reached are computed.

Documents with equal sets are one from here on. ``BANDS`` bands of ``ROWS`` places give candidates: a pair at the
threshold of 0.8 shares a band with probability 0.99997. Each bucket links its members to its centre only, the member
with most collisions. Buckets whose members are then in different components give the remaining pairs: members outside
the bucket's main component meet all others of different components, first their nearest ones and at last all. So no
pair inside a component is ever listed and no link between components is lost.

Pairs are pruned without loss before their texts are compared: a document's parity bitmap has a bit for each residue of
its shingles' hashes, set if an odd number of shingles have it. Two bitmaps differ in no more bits than the sets differ
in shingles, so more differing bits than the threshold allows prove the pair below it. A bitmap has four to eight bits
a shingle; the wider one of two is folded. What is left is verified on the full sets of the words themselves.

In a large bucket members meet in cells, one for each block of members and block of minor members. A block has some
``BLOCK_BYTES`` of bitmaps and bands, so no task holds more than a few blocks, however many documents are alike.

Defined cases: ids are integers, others are refused with a ValueError; null, empty or blank text has the empty set, size
0, and links with nothing; rows without an id have a null component and are kept only by themselves; rows that repeat an
id are one node; equal texts are linked; very long texts are signed and verified whole, with memory in proportion to their sets; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop_cut, long_id, named, text_of, tidy
from .membership import split_by_key

BANDS, ROWS = 45, 7
PLACES = BANDS * ROWS
#: Bytes of one block of a bucket's members, and how many candidates a member gets in each round.
BLOCK_BYTES, ROUNDS = 4 << 20, (4, None)
MIX1, MIX2, GOLD = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


class Shingler:
    """64-bit hashes of a text's distinct shingles, sorted; remembers up to 2**18 words."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def __call__(self, text: str) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > 1 << 18:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(words))
        n = len(words) - k + 1
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = mixed(out * GOLD + h[j : j + n])
        return np.unique(out)


def superminhash(elements: np.ndarray, ends: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signatures of many sets: set i is elements[ends[i-1]:ends[i]]; an empty set keeps the largest values."""
    n = len(ends)
    top = np.iinfo(np.uint64).max
    sig = np.full(n * places, top, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(ends, prepend=0))
    drawn: list[np.ndarray] = []
    for j in range(places):
        if not len(elements):
            break
        r = mixed(elements + np.uint64(int(GOLD) * (j + 1) % (1 << 64)))
        at = (j + (((r >> np.uint64(32)) * np.uint64(places - j)) >> np.uint64(32))).astype(np.int32)
        place = at.copy()
        for i in range(j - 1, -1, -1):
            place[place == drawn[i]] = i  # undo the swaps, the last one first
        np.minimum.at(sig, owner * places + place, (np.uint64(j) << np.uint64(32)) | (r & np.uint64(0xFFFFFFFF)))
        drawn.append(at)
        open_ = np.zeros(n, bool)
        live = np.unique(owner)
        open_[live] = (sig.reshape(n, places)[live] >= np.uint64(j + 1) << np.uint64(32)).any(axis=1)
        stay = open_[owner]
        if not stay.all():
            elements, owner, drawn = elements[stay], owner[stay], [d[stay] for d in drawn]
    return sig.reshape(n, places)


def bands_of(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD), (len(sig), BANDS)).copy()
    for k in range(ROWS):
        out = mixed(out * GOLD + parts[:, :, k])
    return out.view(np.int64)


def parity(elements: np.ndarray) -> bytes:
    """A bit for each residue of the set's elements by a power of two of at least four times their number: whether odd many have it."""
    width = 1 << max(6, (4 * len(elements) - 1).bit_length())
    odd = np.bincount((elements & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def words_in(bits: bytes) -> np.ndarray:
    return np.frombuffer(bits, np.uint64)


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of words) as they would be with ``width`` words, their number or a smaller power of two."""
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def can_reach(differing: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes in total, which differ in so many elements at least, can be alike enough."""
    return (100 + percent) * differing <= (100 - percent) * sizes


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), same (fingerprint of the set), bands, bits (parity bitmap); the last three null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(k)
        for b in batches:
            at = 0
            while at < len(b):
                sets, size, start = [], 0, at
                while at < len(b) and size < 200_000:
                    sets.append(of(b.column("text")[at].as_py()))
                    size += len(sets[-1]) + 8
                    at += 1
                n = np.array([len(s) for s in sets], np.int64)
                sig = superminhash(np.concatenate(sets), n.cumsum())
                has = n > 0
                none = [None] * len(sets)
                same, band, bits = list(none), list(none), list(none)
                for i, x in zip(np.flatnonzero(has), bands_of(sig[has]).tolist(), strict=True):
                    same[i], band[i], bits[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), x, parity(sets[i])
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(start, at - start), pa.array(n), pa.array(same, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    names=["id", "n", "same", "bands", "bits"],
                )

    given = docs.select(long_id(docs, id_col).alias("id"), text_of(text_col).alias("text"))
    return given.mapInArrow(tidy(run), "id long, n long, same binary, bands array<long>, bits binary")


def shingle_set(text: str, k: int) -> set:
    words = words_of(text)
    k = min(k, len(words))
    return set(zip(*(words[j:] for j in range(k)), strict=False)) if words else set()


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) of pairs whose sets satisfy 100 * intersection >= percent * union, judged on the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches:
            a, b, x, y = (batch.column(c) for c in ("a", "b", "text_a", "text_b"))
            hit = []
            for i in range(len(batch)):
                if (now := a[i].as_py()) != last:
                    last, left = now, shingle_set(x[i].as_py(), k)
                right = shingle_set(y[i].as_py(), k)
                both = len(left & right)
                hit.append(100 * both >= percent * (len(left) + len(right) - both))
            hit = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(hit), b.filter(hit)], names=["a", "b"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    needed = cut(split_by_key(docs, wanted, ["id"])[0].join(wanted, "id"))
    text = lambda s: needed.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}"))
    return pairs.select("a", "b").join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long")


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs that sizes and bitmaps do not prove to be below the threshold. sets: id, n, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differing = []
            for x, y in zip(batch.column("bits_a"), batch.column("bits_b"), strict=True):
                x, y = words_in(x.as_py()), words_in(y.as_py())
                width = min(len(x), len(y))
                differing.append(int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum()))
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            fit = pa.array(can_reach(np.array(differing, np.int64), sizes, percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(fit) for c in ("a", "b")], names=["a", "b"])

    side = lambda s: sets.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return met.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(tidy(run), "a long, b long")


def mixed_buckets(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, minor, id, root, n, blocks, minor_blocks) of buckets whose members are in several components; minor: outside the largest of them."""
    placed = keyed.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"), "n")
    # A bitmap has a byte a shingle at most.
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("members"), F.sum(F.col("n") + 8 * BANDS).alias("bytes"))
    main = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("members", "root", "bytes")).alias("main"), F.sum("bytes").alias("bytes")).where("parts > 1")
    blocks = lambda size: F.ceil(size / BLOCK_BYTES).cast("int")
    main = main.select("key", F.col("main.root").alias("main"), blocks(F.col("bytes")).alias("blocks"), blocks(F.col("bytes") - F.col("main.bytes")).alias("minor_blocks"))
    return placed.join(cut(main), "key").select("key", (F.col("root") != F.col("main")).alias("minor"), "id", "root", "n", "blocks", "minor_blocks")


class Cell:
    """A block of a bucket's members, by width of their bitmaps."""

    def __init__(self, ids: np.ndarray, roots: np.ndarray, n: np.ndarray, bits: list[bytes], bands: np.ndarray):
        self.groups = []
        width = np.array([len(b) // 8 for b in bits])
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            words = np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), w)
            self.groups.append((int(w), ids[at], roots[at], n[at], words, bands[at]))

    def near(self, key: int, root: int, n: int, bits: bytes, bands: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, differing bits) of the members that a set can be linked with and whose first common band is this one."""
        mine = words_in(bits)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for w, ids, roots, sizes, words, other in self.groups:
            fit = np.flatnonzero((roots != root) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)))
            if len(fit):
                width = min(w, len(mine))
                differing = np.bitwise_count(folded(words[fit], width) ^ folded(mine, width)).sum(axis=1, dtype=np.int64)
                good = can_reach(differing, sizes[fit] + n, percent)
                fit, differing = fit[good], differing[good]
                first = bands[(other[fit] == bands).argmax(axis=1)] == key
                found.append((ids[fit[first]], differing[first]))
        return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))


def cross_pairs(open_: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """(a, b) of possible pairs of minor members with members of other components, their nearest ones of each block or all.

    A pair that shares several buckets comes from the first of its bands that agree. open_: as of mixed_buckets, with bits and bands.
    """
    cols = ["key", "i", "j", "asks", "id", "root", "n", "bits", "bands"]
    own = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    others = open_.withColumn("i", own("blocks")).withColumn("j", every("minor_blocks")).withColumn("asks", F.lit(False))
    minors = open_.where("minor").withColumn("j", own("minor_blocks")).withColumn("i", every("blocks")).withColumn("asks", F.lit(True))

    def pairs_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        held.clear()
        asks = t.column("asks").to_numpy()
        ids, roots, n = (t.column(c).to_numpy() for c in ("id", "root", "n"))
        bits, bands, key = t.column("bits").to_pylist(), np.stack(t.column("bands").to_numpy()), t.column("key")[0].as_py()
        y = np.flatnonzero(~asks)
        cell = Cell(ids[y], roots[y], n[y], [bits[i] for i in y], bands[y])
        pairs: list[np.ndarray] = []
        for x in np.flatnonzero(asks):
            at, differing = cell.near(key, roots[x], n[x], bits[x], bands[x], percent)
            if nearest is not None and len(at) > nearest:
                at = at[np.argsort(differing, kind="stable")[:nearest]]
            pairs.append(np.stack([np.minimum(at, ids[x]), np.maximum(at, ids[x])]))
            if len(pairs) >= 1000 or pairs[-1].shape[1] > 10_000:
                yield _batch(pairs)
                pairs = []
        yield _batch(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not len(b):
                continue
            cell = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            starts = np.concatenate([[0], np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1, [len(b)]])
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if held and tuple(cell[:, lo]) != last:
                    yield from pairs_of(held)
                last = tuple(cell[:, lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from pairs_of(held)

    met = others.select(*cols).unionByName(minors.select(*cols)).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return met.mapInArrow(tidy(run), "a long, b long").distinct()


def _batch(pairs: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def minhash_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    signed = cut(signatures(docs, k, id_col, text_col))
    sets = signed.where("same is not null and id is not null")
    # Written first, so that the joins read two plain exchanges and a group of very many equal sets can be split.
    heads = cut(sets.groupBy("same").agg(F.min("id").alias("rep")))
    # Every document belongs to the smallest id with its set; an id with several texts links what they belong to.
    member = cut(sets.select("id", "same").join(heads, "same").select("id", "rep"))
    reps = cut(sets.join(heads.select(F.col("rep").alias("id"), "same"), ["same", "id"]).dropDuplicates(["same"]).select("id", "n", "bands", "bits"))
    common = cut(reps.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    keyed = cut(reps.select("id", "n", F.explode("bands").alias("key")).join(common, "key"))
    degree = keyed.groupBy("id").agg(F.sum("size").alias("degree"))
    centre = cut(keyed.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("back"), "n")).alias("c")))
    fit = 100 * F.least("n", F.col("c.n")) >= percent * F.greatest("n", F.col("c.n"))
    stars = keyed.join(centre, "key").where((F.col("id") != -F.col("c.back")) & fit)
    tried = stars.select(F.least("id", -F.col("c.back")).alias("a"), F.greatest("id", -F.col("c.back")).alias("b")).distinct()
    tried = cut(likely(tried, reps, percent))
    texts = docs.select(long_id(docs, id_col).alias("id"), text_of(text_col).alias("text"))
    links = cut(verified(tried, texts, k, percent))
    for nearest in ROUNDS:
        open_ = cut(mixed_buckets(keyed, components(links)).join(reps.select("id", "bits", "bands"), "id"))
        if open_.isEmpty():
            break
        new = cut(cross_pairs(open_, percent, nearest).join(tried, ["a", "b"], "left_anti"))
        drop_cut(open_)
        tried = cut(tried.unionByName(new))
        links = cut(links.unionByName(verified(new, texts, k, percent)))
        drop_cut(new)
    for done in (common, keyed, centre, tried, reps):
        drop_cut(done)
    roots = components(links.unionByName(member.select(F.col("rep").alias("a"), F.col("id").alias("b"))))
    return signed.join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("root", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("root", "id")).alias("kept"),
    )


def keep_representatives(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the members of near-duplicate groups other than the smallest id; rows without an id stay."""
    groups = minhash_dedup(docs.select(named(id_col), named(text_col)), k, percent, id_col, text_col)
    gone = cut(groups.where(~F.col("kept")).select(named(id_col).alias("gone id")).distinct())
    return docs.join(gone, named(id_col) == F.col("gone id"), "left_anti")
