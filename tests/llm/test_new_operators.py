"""Vector codes, source divergence and sharding against plain recomputations, and their defined edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from paperlake.llm import divergence, queries, sharding, vector_codes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, shard int, slot int, row string, term string"


def lloyd(rows, parts, entries, rounds, scale):
    """rows: (id, label, vector), in order of id. Python integers only."""
    full = max((len(v) for _, _, v in rows), default=0)
    width = max(1, -(-full // parts))
    q = [[math.floor(scale * x) for x in v] + [0] * (width * parts - len(v)) for _, _, v in rows]
    cells = [[r[p * width : (p + 1) * width] for p in range(parts)] for r in q]
    books = [[c[p] for c in cells[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c in cells:
                held[nearest(c[p], books[p])[1]].append(c[p])
            for k, xs in held.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cells]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, label, _), e in zip(rows, errors, strict=True):
        by_label[label] += e
    return {(i, label, tuple(k for _, k in f), e, by_label[label]): 1 for (i, label, _), f, e in zip(rows, found, errors, strict=True)}, books


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def vectors(n, width, seed, grain):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, width))
    return [[float(np.round(x * grain) / grain) for x in centres[r.integers(12)] + r.normal(scale=0.3, size=width)] for _ in range(n)]


@pytest.mark.parametrize(("grain", "entries", "rounds", "parts", "scale"), [(2, 24, 4, 4, 1024), (1, 40, 6, 4, 2), (64, 33, 3, 3, 1024), (2, 24, 0, 4, 1024)])
def test_vector_codes(spark, grain, entries, rounds, parts, scale):
    # Coarse grains bring many exact ties, so that the lower index has to win.
    rows = [(i, [None, 0, 1, 1][i % 4], v) for i, v in enumerate(vectors(300, 12, grain, grain))]
    rows += [(300, 7, None), (301, 7, [1.0, None, 2.0] * 4), (302, 7, [float("nan")] * 12), (303, 7, [float("inf")] + [0.0] * 11), (304, 8, [0.5] * 7), (305, 8, [])]
    rows += [rows[5], rows[5], rows[9]]
    want, books = lloyd(sorted((r for r in rows if good(r[2])), key=lambda r: r[0]), parts, entries, rounds, scale)
    shown = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, codes string").repartition(3)
    done = vector_codes.compress(shown, parts, entries, rounds, scale)
    got = Counter((r["id"], r["label"], tuple(r["codes"]), r["error"], r["label_error"]) for r in done.codes.collect())
    assert done.codebooks.tolist() == books
    assert set(got) == set(want) and got.total() == sum(good(r[2]) for r in rows)


def test_vector_codes_of_large_components_and_few_rows(spark):
    rows = [(i, 0, v) for i, v in enumerate([[150000.5, -150000.25, 3.0, 4.0], [150000.5, -150000.25, 3.0, 5.0], [-150000.0, 150000.0, 0.0, 0.0], [1e-7, -1e-7, 0.0, -0.0]])]
    want, books = lloyd(rows, 4, 256, 4, 1024)
    done = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    assert {(r["id"], r["label"], tuple(r["codes"]), r["error"], r["label_error"]) for r in done.codes.collect()} == set(want) and done.codebooks.tolist() == books
    held = vector_codes.compress(spark.createDataFrame([(1, 0, [1e300, -1e300, 0.0, 1.0]), (None, None, [0.0] * 4)], "vec_id long, label int, embedding array<double>"))
    assert [(r["id"], len(r["codes"])) for r in held.codes.orderBy("id").collect()] == [(None, 4), (1, 4)]
    empty = vector_codes.compress(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"))
    assert empty.codes.count() == 0 and empty.spelled() == ""


def test_bounds_skip_and_stay_exact():
    r = np.random.default_rng(1)
    x, book = r.integers(-60, 60, (900, 6)), r.integers(-60, 60, (64, 6))
    groups = vector_codes.grouped(book)
    side = vector_codes.Bounds(book, groups)
    entry, d, lower = side.first(x)
    scans = []
    for _ in range(6):
        moved = book + r.integers(-1, 2, book.shape) * (r.random((64, 1)) < 0.3)
        drift, book = np.sqrt(((moved - book) ** 2).sum(1)), moved
        side = vector_codes.Bounds(book, groups)
        whole = side.nearest
        side.nearest = lambda y, g, whole=whole: scans.append(len(y)) or whole(y, g)
        entry, upper, lower = side.again(x, entry, np.sqrt(d) * vector_codes.UP, lower, drift)
        every = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (entry == every.argmin(1)).all()
        d = every.min(1)
    assert 0 < sum(scans) < 0.7 * 6 * len(x) * len(side.members)


def brute_audit(docs, least, top):
    words = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for text, lang, source in docs]
    out = []
    for lang in {x for x, _, _ in words}:
        groups = {s: Counter() for x, s, _ in words if x == lang}
        seen = Counter()
        for x, s, ws in words:
            if x == lang:
                groups[s].update(ws)
                seen.update(set(ws))
        kept = [t for t, n in seen.items() if n >= least]
        p = {}
        for name, c in [*groups.items(), (None, sum(groups.values(), Counter()))]:
            size = sum(c[t] for t in kept)
            p[name] = {t: 1 + 10**9 * (c[t] + 5) // (size + 5 * len(kept)) for t in kept}
        for s, c in groups.items():
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - p[None][t], t) for t in kept if c[t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, o, v, k + 1) for k, (v, o) in enumerate(sorted(found, key=lambda f: (-f[0], f[1].encode()))[:most])]
    return Counter(out)


@pytest.mark.parametrize(("heavy", "block", "terms"), [(8, 64, 4096), (2, 3, 5), (0, 2, 3), (99, 64, 4096)])
def test_divergence(spark, monkeypatch, heavy, block, terms):
    for name, value in (("HEAVY", heavy), ("TILE_GROUPS", block), ("TILE_TERMS", terms), ("HELD", 50)):
        monkeypatch.setattr(divergence, name, value)
    r = np.random.default_rng(heavy)
    pool = [f"{a}{b}" for a in "abcÄé漢" for b in "xyz"] + ["The", "THE", "the", "a1b", "don't", "�"]
    docs = []
    for k in range(160):
        source = [None, "", *"pqrstuvw"][int(r.integers(10))]
        some = r.choice(pool, int(r.integers(0, 30)), p=np.arange(len(pool), 0, -1) / sum(range(len(pool) + 1)))
        docs.append((" ".join(some) if k % 11 else None, ["en", "fr", None][k % 3], source))
    docs += [("alone in here", "xx", "only"), (None, "yy", "p"), (None, "yy", "q"), ("the " * 3000, "en", "p"), docs[1], docs[1]]
    frame = spark.createDataFrame([(t, x, s, "n", 1) for t, x, s in docs], "text string, lang string, source string, term string, nth int").repartition(4)
    got = Counter(tuple(row) for row in divergence.audit(frame, 6, 4).collect())
    assert got == brute_audit(docs, 6, 4)
    assert any(k[2] == "term" for k in got) and any(k[4] for k in got if k[2] == "pair") and ("yy", "p", "pair", "q", 0, 1) in got


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_op11_and_op12_take_every_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source").collect()
    assert Counter(tuple(r) for r in queries.op12_source_divergence(spark, sf_dir).collect()) == brute_audit([tuple(r) for r in docs], 30, 50)
    rows = sorted((tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").collect()), key=lambda r: r[0])
    x = np.floor(1024 * np.array([v for _, _, v in rows], np.float64)).astype(np.int64).reshape(len(rows), 4, -1).transpose(1, 0, 2)
    books = x[:, :256].copy()
    for k in range(5):
        d = ((x[:, :, None] - books[:, None]) ** 2).sum(3)
        at = d.argmin(2)
        for p, e in {(p, e) for p in range(4) for e in at[p].tolist()} if k < 4 else ():
            books[p, e] = x[p][at[p] == e].sum(0) // (at[p] == e).sum()
    errors = d.min(2).sum(0)
    sums = Counter()
    for (_, label, _), e in zip(rows, errors.tolist(), strict=True):
        sums[label] += e
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    want = {(i, "".join(f"{e:02x}" for e in at[:, k]), int(errors[k]), sums[label], sha) for k, (i, label, _) in enumerate(rows)}
    assert {tuple(r) for r in queries.op11_vector_codes(spark, sf_dir).collect()} == want


def plain_shards(rows, shards, seed):
    """rows: (bucket, key, value); shard and slot of each value, by a permutation of each bucket in turn."""
    order = []
    for bucket in sorted({b for b, _, _ in rows}):
        held = [v for b, _, v in sorted(r for r in rows if r[0] == bucket)]
        draws = np.random.Generator(np.random.PCG64([seed, bucket])).integers(0, np.arange(len(held), 0, -1))
        for k, j in enumerate(draws.tolist()):
            i = len(held) - 1 - k
            held[i], held[j] = held[j], held[i]
        order += held
    out, filled = {}, Counter()
    for i, v in enumerate(order):
        s = i * shards // len(order)
        out[v] = (s, filled[s])
        filled[s] += 1
    return out


def test_sharding_equals_a_plain_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in queries.op13_sharding(spark, sf_dir).collect()}
    placed = docs.selectExpr("doc_id", "coalesce(text, '') AS text", f"xxhash64({sharding.SEED}, doc_id, coalesce(text, '')) AS key").selectExpr("*", f"pmod(xxhash64(key, {sharding.SEED}), {sharding.MIN_BUCKETS}L) AS bucket").collect()
    want = plain_shards([(r.bucket, r.key, r.doc_id) for r in placed], 16, sharding.SEED)
    assert len(got) == len(placed)
    for r in placed:
        data = r.text.encode()
        assert got[r.doc_id] == (r.doc_id, len(data) + 1, zlib.crc32(data), "rows", *want[r.doc_id], None)
    counts = Counter(v[4] for v in got.values())
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_sharding_of_hard_rows(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(sharding, "BROADCAST_BUCKETS", limit)
    monkeypatch.setattr(sharding, "BROADCAST_CROWDS", limit)
    # A crowd of 400 equal rows, null ids and texts, a very long text.
    rows = [(i, f"text {i}", "en", "s", 1, "b", 3, 9, "r", "t") for i in range(500)] + [(7, "again " * 50, None, None, None, "b", 3, 9, "r", "t")] * 400
    rows += [(None, None, None, None, None, None, None, None, None, None)] * 5 + [(9000, "é" * 300_000, None, None, None, None, None, None, None, None), (9001, "", None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    done = sharding.write_shards(docs, str(tmp_path / "out"), 5, bucket_bytes=1 << 15)
    got = done.collect()
    assert Counter(tuple(r["row"]) for r in got) == Counter(rows)
    assert all(r["size"] == len((r["row"]["text"] or "").encode()) + 1 for r in got)
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(len([r for r in got if r["shard"] == s])))
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 5
    # The crowd is spread over all shards, and the files of a shard are in the order of its slots.
    assert all(c > 20 for c in Counter(r["shard"] for r in got if r["row"]["doc_id"] == 7).values())
    for f in (tmp_path / "out").glob("shard=*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(f)).select("slot").collect()]
        assert slots == sorted(slots)


def test_sharding_reruns_agree_and_small_tables(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(100)], "doc_id long, text string")
    first, second = ({r["row"]["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(x, 4).collect()} for x in (docs, docs.repartition(7)))
    assert first == second and first != {r["row"]["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs, 4, seed=1).collect()}
    assert sharding.shard(docs.limit(0), 4).count() == 0
    few = sharding.shard(docs.limit(3), 16).collect()
    assert len({r["shard"] for r in few}) == 3 and all(r["slot"] == 0 for r in few)


def test_fisher_yates_is_a_permutation():
    assert [sorted(sharding.fisher_yates(n, 1, 2)) for n in (0, 1, 50)] == [list(range(n)) for n in (0, 1, 50)]
    firsts = Counter(sharding.fisher_yates(6, 3, b)[0] for b in range(3000))
    assert all(400 < firsts[k] < 600 for k in range(6))


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    r = np.random.default_rng(2)
    pool = ["".join(r.choice(list("abcdefgh"), 5)) for _ in range(300)]
    line = "this very line stands in several of the documents"
    rows = [(i, " ".join(r.choice(pool, 40)) + (f"\n{line}" if i % 3 == 0 else ""), ["en", None][i % 2], ["s", "t"][i % 2], 5, f"mine {i}", i + 0.5, i, 88, "thr", "ids", "tok") for i in range(40)]
    rows += [rows[3], rows[4], (None, None, None, None, None, None, None, None, None, None, None, None), (None, "a b c", None, None, 1, "n", 1.0, 2, 3, "x", "y", "z"), (50, "", "en", "s", 0, "e", 0.0, 1, 2, "x", "y", "z")]
    names = "doc_id long, text string, lang string, source string, n_chars int, rejected string, score double, n_lines long, n_removed int, threshold string, ids string, n_tokens string"
    docs = spark.createDataFrame(rows, names).repartition(2)
    spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    extra = {x[0]: x[5:] for x in rows if x[0] is not None}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, str(tmp_path))
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0 and none.columns == done.columns
        got = done.collect()
        if name == "bpe":
            assert {"ids", "decoded", "n_tokens", "score", "n_removed"} <= set(done.columns) and len(done.columns) == len(set(done.columns))
            assert all(x.score == extra[x.doc_id][1] for x in got if x.doc_id is not None)
            break
        assert done.schema.simpleString() == docs.schema.simpleString()
        assert got and all(tuple(x)[5:] == extra[x.doc_id] for x in got if x.doc_id is not None)
        if name == "line_dedup":
            assert sum(line in (x.text or "") for x in got) == 1 and any(x.n_chars != 5 for x in got) and any(x.n_chars == 5 for x in got)
        if name != "source_mixing":
            assert sum(x.doc_id is None for x in got) == 2
        docs = done.cache()


def test_suffix_dedup_leaves_one_of_equal_rows(spark):
    from paperlake.llm import suffix_dedup

    r = np.random.default_rng(4)
    text = "".join(chr(97 + k) for k in r.integers(0, 26, 999))
    rows = [(1, text, "x"), (1, text, "y"), (2, "x " + text, "z"), (3, "short", "a"), (3, "short", "b"), (4, text, "c"), (4, text, "c"), (4, text, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    first = Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept).decode()) for x in suffix_dedup.suffix_dedup(docs).collect())
    assert first == Counter({(1, 999, 0, 0, text): 1, (1, 999, 999, 1, ""): 1, (2, 1001, 999, 1, "x "): 1, (3, 5, 0, 0, "short"): 2, (4, 999, 999, 1, ""): 3})
    none = suffix_dedup.suffix_dedup(docs, keep="none").collect()
    assert Counter((x.doc_id, x.n_removed) for x in none) == Counter({(1, 999): 2, (2, 999): 1, (3, 0): 2, (4, 999): 3})
