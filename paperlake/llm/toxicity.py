"""Toxicity: a convolutional text classifier trained in numpy.

Words are lower-cased runs of letters and digits; a word's embedding is the sum of two hashed ones, of the word and of
its first ``STEM`` letters, so that inflected forms share what is learnt. Filters of widths 1, 2 and 3 run
over the whole text, each keeps its largest answer (max pooling), and a linear layer scores the pooled answers. The
first embedding dimension starts from the smoothed log-odds of a bucket's documents, the rest at random; training is
plain back-propagation through the pooled positions with Adagrad steps, and the best epoch on a validation part stays.

Every labelled document counts, whatever its length: a fifth, by a hash of the id, validates and all others are learnt from. They lie in
blocks of some ``BLOCK`` documents or ``BLOCK_WORDS`` words, dealt by a hash. Documents of buckets are counted over all blocks; in
each epoch every block is a task that trains on from the same model, and a bucket's changes are averaged over the blocks that touched it, all other
parameters over all blocks (local SGD; one block is plain SGD). A block is a partition of its own with a row for each document, written as one file, and a
task reads its files one block after the other. The driver holds the model alone, and for thresholds the counts of
validation documents by logit, rounded to 1 / ``GRID``. Scores are calibrated on the validation part so
that the best global threshold lies at ``CUT``; ``thresholds`` holds one for each language with enough validation
documents of both classes (the language picks a threshold, it is never an input of a score), otherwise ``CUT``. Where the fifth or the rest lacks
a class, all documents both teach and validate.

Defined cases: ids are integers, others are refused with a ValueError; null text is the empty text, which gets the score of a text without any word; unlabelled rows and null
labels teach nothing; without documents of both classes every score is the share of toxic labels, 0 if there are none;
of several labels of a document the largest counts; repeated rows get equal scores; any language, null included, has a
threshold; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, long_id, named, text_of, tidy
from .membership import split_by_key

BUCKETS, STEM, DIM, WIDTHS, FILTERS = 1 << 17, 4, 8, (1, 2, 3), 8
EPOCHS, CUT, LEAST = 6, 0.3, 25
#: Documents and words of a block on average, buckets of a piece of the model, steps of a logit that thresholds tell apart, words convolved at once in
#: training and, of one document or many, in scoring.
BLOCK, BLOCK_WORDS, PIECE, GRID, SPAN, TOGETHER = 4000, 2_000_000, 1024, 1000, 1 << 16, 1 << 12
_WORDS = re.compile(r"[^\W_]+")


class Numbers(dict):
    """Both bucket numbers of a word, found when it is first asked for."""

    def __missing__(self, w: str) -> int:
        self[w] = both = crc32(w.encode()) % BUCKETS << 32 | crc32(b"stem " + w[:STEM].encode()) % BUCKETS
        return both


class Hasher:
    """Two bucket numbers for each word of a text, of the word and of its stem; remembers up to 2**16 words."""

    def __init__(self):
        self.known = Numbers()

    def __call__(self, text: str) -> np.ndarray:
        words = _WORDS.findall(text.lower())
        if len(self.known) >= 1 << 16:
            self.known.clear()
        both = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return np.stack([both >> 32, both & 0xFFFFFFFF], axis=1).astype(np.int32)


def padded(ids: np.ndarray) -> np.ndarray:
    """With the empty bucket behind, so that every filter fits."""
    return np.concatenate([ids, np.full((max(WIDTHS), 2), BUCKETS, np.int32)])


@dataclass
class Model:
    words: np.ndarray  # BUCKETS + 1 rows, the last of zeros
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    shift: np.ndarray
    out: np.ndarray
    bias: float
    scale: float = 1.0
    centre: float = 0.0
    thresholds: dict = field(default_factory=dict)
    constant: float | None = None

    def table(self) -> np.ndarray:
        """What each bucket adds to the answers: FILTERS columns for each place of each width."""
        out = np.empty((len(self.words), sum(WIDTHS) * FILTERS), np.float32)
        for c, part in enumerate(part for f in self.filters for part in f):
            out[:, c * FILTERS : (c + 1) * FILTERS] = self.words @ part
        return out

    def logits(self, docs: Iterable[np.ndarray], table: np.ndarray) -> list[float]:
        """A logit for each document, of the bucket numbers of its words; some TOGETHER words are looked up at once, of one document or many."""
        best, group, size = [], [], 0

        def done() -> None:
            for (k, _), top in zip(group, pooled([x for _, x in group], table), strict=True):
                best[k] = np.maximum(best[k], top)
            group.clear()

        for k, ids in enumerate(docs):
            x = padded(ids)
            best.append(np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32))
            for low in range(0, len(x) - max(WIDTHS) + 1, TOGETHER):
                part = x[low : low + TOGETHER + max(WIDTHS) - 1]
                if size + len(part) > 2 * TOGETHER:
                    done()
                    size = 0
                group.append((k, part))
                size += len(part)
        if group:
            done()
        return [float(np.maximum(top + self.shift, 0) @ self.out + self.bias) for top in best]

    def score(self, logit: float) -> float:
        if self.constant is not None:
            return self.constant
        z = self.scale * (logit - self.centre) + np.log(CUT / (1 - CUT))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def pooled(parts: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Each filter's largest answer over each of the parts, which lie one behind the other; the last places of a part are left to the widths that fit."""
    x, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    y = table.take(x[:, 0], axis=0)
    y += table.take(x[:, 1], axis=0)
    answers, c = np.full((len(x), len(WIDTHS) * FILTERS), -np.inf, np.float32), 0
    for i, w in enumerate(WIDTHS):
        m, own = len(x) - w + 1, slice(i * FILTERS, (i + 1) * FILTERS)
        answers[:m, own] = y[:m, c : c + FILTERS]
        for j in range(1, w):
            answers[:m, own] += y[j : m + j, c + j * FILTERS : c + (j + 1) * FILTERS]
            answers[ends - j, own] = -np.inf
        c += w * FILTERS
    return np.maximum.reduceat(answers, ends - [len(p) for p in parts], axis=0)


def best_cut(z: np.ndarray, n: np.ndarray, hit: np.ndarray) -> tuple[float, float]:
    """The threshold of the largest F1, between two logits, and this F1; z: distinct logits, n and hit: documents and toxic ones at each."""
    order = np.argsort(-z)
    z, said, right = z[order], np.cumsum(n[order]), np.cumsum(hit[order])
    f1 = 2 * right / (said + hit.sum())
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1), float(f1[k])


def start(seed: int) -> tuple[dict, dict]:
    """Parameters at random and Adagrad's sums; columns of ``filters``: FILTERS for each place of each width."""
    rng, total = np.random.default_rng(seed), len(WIDTHS) * FILTERS
    filters = np.concatenate([rng.normal(0, 0.3, (DIM, FILTERS)) for w in WIDTHS for _ in range(w)], axis=1).astype(np.float32)
    filters[0] = np.abs(filters[0]) + 0.3
    words = np.vstack([rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((1, DIM))]).astype(np.float32)
    p = {"words": words, "filters": filters, "shift": np.zeros(total, np.float32), "out": rng.normal(0.3, 0.1, total).astype(np.float32), "bias": np.full(1, -1, np.float32)}
    return p, {k: np.full(len(v) if k == "words" else v.shape, 1e-2, np.float32) for k, v in p.items()}


def model_of(p: dict) -> Model:
    places = np.split(p["filters"], sum(WIDTHS), axis=1)
    return Model(p["words"], [np.stack([places.pop(0) for _ in range(w)]) for w in WIDTHS], p["shift"], p["out"], float(p["bias"][0]))


def strongest(x: np.ndarray, words: np.ndarray, filters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest answer over the padded bucket numbers x and where it is, SPAN words at a time."""
    best, at = np.full((len(WIDTHS), FILTERS), -np.inf, np.float32), np.zeros((len(WIDTHS), FILTERS), np.int64)
    for low in range(0, max(1, len(x) - max(WIDTHS) + 1), SPAN):
        part = x[low : low + SPAN + max(WIDTHS) - 1]
        y, c = (words[part[:, 0]] + words[part[:, 1]]) @ filters, 0
        for i, w in enumerate(WIDTHS):
            m = len(part) - w + 1
            answer = y[:m, c : c + FILTERS]
            for j in range(1, w):
                answer = answer + y[j : m + j, c + j * FILTERS : c + (j + 1) * FILTERS]
            c += w * FILTERS
            where = answer.argmax(axis=0)
            top = answer[where, np.arange(FILTERS)]
            better = top > best[i]
            best[i][better], at[i][better] = top[better], where[better] + low
    return best, at


def learn(p: dict, sums: dict, docs: list[np.ndarray], labels: np.ndarray, weights: tuple, rate: float, order: np.ndarray) -> np.ndarray:
    """One epoch over the documents, in place; gives the buckets that were touched. docs: the bucket numbers of each document's words, two a word."""
    words, filters, shift, out, bias = (p[k] for k in ("words", "filters", "shift", "out", "bias"))
    group = np.repeat(np.arange(len(WIDTHS)), WIDTHS)
    place = np.concatenate([np.arange(w) for w in WIDTHS])
    touched_ever = np.zeros(BUCKETS + 1, bool)
    for k in order:
        x = padded(docs[k])
        best, at = strongest(x, words, filters)
        active = best.ravel() + shift
        h = np.maximum(active, 0)
        z = float(np.clip(h @ out + bias[0], -30, 30))
        g = (1 / (1 + np.exp(-z)) - labels[k]) * weights[labels[k]]
        gh = g * out * (active > 0)
        gout = g * h + 1e-4 * out
        # One row for each filter and place: the words under it, and what they and its weights move by.
        rows = (at[group] + place[:, None]).ravel()
        own = gh.reshape(len(WIDTHS), FILTERS)[group].ravel()[:, None]
        under = x[rows]
        gw, gf = own * filters.T, ((words[under[:, 0]] + words[under[:, 1]]) * own).T
        sums["filters"] += gf**2
        filters -= rate * gf / np.sqrt(sums["filters"])
        touched, gw = under.T.ravel(), np.concatenate([gw, gw])
        touched_ever[touched] = True
        np.add.at(sums["words"], touched, (gw**2).mean(axis=1))
        np.add.at(words, touched, -rate * gw / np.sqrt(sums["words"][touched])[:, None])
        words[BUCKETS] = 0
        for key, grad in (("out", gout), ("shift", gh), ("bias", np.full(1, g))):
            sums[key] += grad**2
            p[key] -= (rate * grad / np.sqrt(sums[key])).astype(np.float32)
    return touched_ever[:BUCKETS]


ROWS = "block int, id long, label int, held boolean, lang string, words binary"
PIECES = "piece int, block long, data binary"


@dataclass
class Block:
    number: int
    docs: list[np.ndarray]  # the bucket numbers of each document's words, two a word
    labels: np.ndarray
    held: np.ndarray
    langs: list[str | None]


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The blocks among rows of ROWS, in which the rows of a block stand together; texts are not copied."""
    parts: list[pa.RecordBatch] = []

    def whole() -> Block:
        docs = [np.frombuffer(w.as_buffer(), np.int32).reshape(-1, 2) for p in parts for w in p.column("words")]
        labels, held = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("label", "held"))
        return Block(parts[0].column("block")[0].as_py(), docs, labels.astype(np.int64), held.astype(np.bool_), [x for p in parts for x in p.column("lang").to_pylist()])

    for b in batches:
        names = b.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(b)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if low == high:
                continue
            if parts and parts[0].column("block")[0].as_py() != names[low]:
                yield whole()
                parts.clear()
            parts.append(b.slice(low, high - low))
    if parts:
        yield whole()


def summed(pieces: DataFrame, width: int) -> dict[int, np.ndarray]:
    """The sum of each piece over the blocks, in their order."""

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        total = np.zeros(len(rows["data"][0].as_buffer()) // 4, np.float64)
        for d in rows["data"]:
            total += np.frombuffer(d.as_buffer(), np.float32)
        return pa.table({"piece": rows["piece"].slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    got = pieces.groupBy("piece").applyInArrow(add, "piece int, data binary").collect()
    return {r["piece"]: np.frombuffer(r["data"], np.float64).reshape(-1, width) if r["piece"] >= 0 else np.frombuffer(r["data"], np.float64) for r in got}


def of_pieces(block: int, table: np.ndarray, more: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of PIECES: a row for each PIECE buckets of table, and one for what is no bucket's."""
    data = [table[i : i + PIECE].astype(np.float32).tobytes() for i in range(0, len(table), PIECE)] + ([] if more is None else [more.astype(np.float32).tobytes()])
    names = [*range(-(-len(table) // PIECE)), *([] if more is None else [-1])]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([block] * len(names), pa.int64()), pa.array(data, pa.binary())], names=["piece", "block", "data"])


def document_counts(blocks: DataFrame, both: bool) -> np.ndarray:
    """(2, BUCKETS): the documents of each class that hold each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks_of(batches):
            seen = np.zeros((BUCKETS, 2))
            for k in np.flatnonzero(~b.held | both):
                seen[np.unique(b.docs[k]), b.labels[k]] += 1
            yield of_pieces(b.number, seen)

    got = summed(blocks.mapInArrow(tidy(run), PIECES), 2)
    return np.concatenate([got[i] for i in sorted(got)]).T


def epoch_over(blocks: DataFrame, p: dict, sums: dict, both: bool, weights: tuple, rate: float, seed: list[int]) -> tuple[dict, dict]:
    """The parameters and sums after every block has learnt one epoch from the same ones."""
    shared = blocks.sparkSession.sparkContext.broadcast((p, sums))
    rest = [k for k in p if k != "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks_of(batches):
            before, sums_before = shared.value
            now, sums_now = ({k: v.copy() for k, v in x.items()} for x in (before, sums_before))
            rng = np.random.default_rng([*seed, b.number])
            touched = learn(now, sums_now, b.docs, b.labels, weights, rate, rng.permutation(np.flatnonzero(~b.held | both)))
            moved = np.column_stack([now["words"] - before["words"], sums_now["words"] - sums_before["words"]])[:BUCKETS]
            flat = [(x[k] - y[k]).ravel() for x, y in ((now, before), (sums_now, sums_before)) for k in rest]
            yield of_pieces(b.number, np.column_stack([moved, touched]), np.concatenate([*flat, np.ones(1)]))

    got = summed(blocks.mapInArrow(tidy(run), PIECES), DIM + 2)
    shared.unpersist()
    other = got.pop(-1)
    table = np.concatenate([got[i] for i in sorted(got)])
    moved = table[:, :-1] / np.maximum(table[:, -1:], 1)
    p, sums = ({k: v.copy() for k, v in x.items()} for x in (p, sums))
    p["words"][:BUCKETS] += moved[:, :DIM].astype(np.float32)
    sums["words"][:BUCKETS] += moved[:, DIM].astype(np.float32)
    at = 0
    for x in (p, sums):
        for k in rest:
            x[k] += (other[at : at + x[k].size] / other[-1]).reshape(x[k].shape).astype(np.float32)
            at += x[k].size
    return p, sums


def judged(blocks: DataFrame, model: Model, both: bool) -> DataFrame:
    """(lang, step, n, hit): validation documents and toxic ones by rounded logit."""
    shared = blocks.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        table = m.table()
        for b in blocks_of(batches):
            some = np.flatnonzero(b.held | both)
            steps = [round(z * GRID) for z in m.logits((b.docs[k] for k in some), table)]
            yield pa.RecordBatch.from_arrays([pa.array([b.langs[k] for k in some], pa.string()), pa.array(steps, pa.int64()), pa.array(b.labels[some], pa.int64())], names=["lang", "step", "label"])

    return blocks.mapInArrow(tidy(run), "lang string, step long, label long").groupBy("lang", "step").agg(F.count("*").alias("n"), F.sum("label").alias("hit"))


def by_step(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([r["step"] for r in rows]) / GRID, np.array([r["n"] for r in rows], float), np.array([r["hit"] for r in rows], float)


def labelled_blocks(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, lang_col: str | None) -> tuple[DataFrame, dict]:
    """(rows of ROWS, documents by (held, label)): every labelled document, by block."""
    own, kind, told = long_id(docs, id_col), long_id(labels, id_col), named(label_col)
    known = cut(labels.where(told.isNotNull() & kind.isNotNull()).groupBy(kind.alias("id")).agg((F.max(told) > 0).cast("int").alias("label")))
    lang = named(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    given = docs.select(own.alias("id"), text_of(text_col).alias("text"), lang.alias("lang"))
    found = split_by_key(given, known, ["id"])[0].join(known, "id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Hasher()
        for b in batches:
            ids = pa.array([of(t.as_py()).tobytes() for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "label", "lang")), ids], names=["id", "label", "lang", "words"])

    rows = cut(found.mapInArrow(tidy(hashed), "id long, label int, lang string, words binary"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("words")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // BLOCK), -(-size["bytes"] // (8 * BLOCK_WORDS)))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            ids, words, keep = b.column("id").to_numpy(), b.column("words"), np.ones(len(b), bool)
            for k in range(len(b)):
                keep[k] = last is None or last[0] != ids[k] or last[1] != words[k]
                last = (ids[k], words[k])
            yield b if keep.all() else b.filter(pa.array(keep))

    # Equal rows of one id meet in one block and count once, in the first language.
    dealt = rows.withColumns({"block": F.pmod(F.xxhash64("id", "words"), F.lit(blocks)).cast("int"), "held": F.pmod(F.xxhash64("id", F.lit("held")), F.lit(5)) == 0})
    by_block = dealt.repartitionById(blocks, "block").sortWithinPartitions("block", "id", "words", F.col("lang").asc_nulls_last())
    packed = cut(by_block.select("block", "id", "label", "held", "lang", "words").mapInArrow(tidy(once), ROWS))
    drop_cut(rows)
    drop_cut(known)
    counts = packed.groupBy("held", "label").agg(F.count("*").alias("n")).collect()
    return packed, {(r["held"], r["label"]): r["n"] for r in counts}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang", seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Train on all labelled documents."""
    blocks, n = labelled_blocks(docs, labels, id_col, text_col, label_col, lang_col)
    total = [n.get((False, y), 0) + n.get((True, y), 0) for y in (0, 1)]
    p, sums = start(seed)
    if not all(total):
        drop_cut(blocks)
        model = model_of(p)
        model.constant = float(total[1] > 0)
        return model
    both = not all(n.get((h, y), 0) for h in (False, True) for y in (0, 1))
    clean, toxic = total if both else (n[False, 0], n[False, 1])
    prior = toxic / (clean + toxic)
    seen = document_counts(blocks, both) + 3
    odds = np.log(seen[1] / seen[0]) - np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)) * (seen.sum(0) > 6)
    p["words"][:BUCKETS, 0] = np.clip(odds - np.median(odds), -3, 3)
    weights, best = (0.5 / max(1 - prior, 1e-3), 0.5 / max(prior, 1e-3)), None
    for epoch in range(epochs):
        p, sums = epoch_over(blocks, p, sums, both, weights, 0.05 / (1 + epoch), [seed, epoch])
        model = model_of(p)
        z, many, hit = by_step(judged(blocks, model, both).groupBy("step").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).collect())
        at, f1 = best_cut(z, many, hit)
        if best is None or f1 > best[0] + 1e-9:
            model.centre, mean = at, (z * many).sum() / many.sum()
            spread = (((z - mean) ** 2 * many).sum() / many.sum()) ** 0.5
            model.scale = float(1.5 / max(spread, 1e-6))
            best = (f1, model)
    model = best[1]
    told = cut(judged(blocks, model, both))
    enough = [r["lang"] for r in told.groupBy("lang").agg(F.sum("hit").alias("y"), F.sum("n").alias("n")).where(F.least("y", F.col("n") - F.col("y")) >= LEAST).collect()]
    for lang in enough:
        rows = told.where(F.col("lang").eqNullSafe(F.lit(lang))).select("step", "n", "hit").collect()
        model.thresholds[lang] = model.score(best_cut(*by_step(rows))[0])
    drop_cut(told)
    drop_cut(blocks)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) with score, threshold (of the language) and rejected (score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "threshold", "rejected")]
    lang = named(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    # A text that travels in the row is read there: sent beside it, a batch would hold it twice, in the JVM and in the worker.
    inside = kept.index(text_col) if text_col in kept and dict(docs.dtypes)[text_col] == "string" else None
    beside = [] if inside is not None else [text_of(text_col).alias("text")]
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")]).alias("row"), *beside, lang.alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Loaded by each task: what a worker keeps counts against an executor's memory in all later stages.
        m, of = Model(**shared.value), Hasher()
        table = m.table()
        for b in batches:
            texts = b.column("text") if inside is None else b.column("row").field(inside)
            scores = [m.score(z) for z in m.logits((of(t.as_py() or "") for t in texts), table)]
            cuts = [m.thresholds.get(x.as_py(), CUT) for x in b.column("lang")]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(scores, pa.float64()), pa.array(cuts, pa.float64())], names=["row", "score", "threshold"])

    done = given.mapInArrow(tidy(run), f"row {given.schema['row'].dataType.simpleString()}, score double, threshold double")
    return done.select(*[F.col("row")[c].alias(c) for c in kept], "score", "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"))
