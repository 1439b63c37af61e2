"""The training-data operators on small frames: brute force, round trips and the defined edge cases."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from paperlake.llm import bpe, chat_format, common, embedding_dedup, exact_dedup, line_dedup, minhash_dedup, mixing, queries, suffix_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, key string, keep_id string"
RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdefgh"), 4)) for _ in range(400)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


def rows_of():
    base = prose(200, 1)
    near = base.split(" ")
    near[17] = "changed"
    texts = [base, base, " ".join(near), prose(150, 2), "", None, "  \n\t ", "one", "one two", "idiot " + prose(40, 3), prose(60, 4) + "\n" + base[:700] + "\n" + prose(20, 5), base.upper(), prose(30000, 6), "é" * 500 + base]
    out = [(i, t, ["en", None, "fr"][i % 3], ["s", "t", None][i % 3], 1, "x", 7, "k", "z") for i, t in enumerate(texts)]
    return out + [out[3], out[3][:1] + out[4][1:], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("most", [500_000, 40])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(common, "FOREST_EDGES", most)
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(4000, 4100)] + [(1, 1), (None, 2)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    nodes = {x for e in edges for x in e if x is not None}
    assert {x: got.get(x, x) for x in nodes} == {x: top(x) for x in nodes}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("length", [12, 90])
def test_longest_previous_factors(length):
    text = (prose(60, 7) + " \0\0" + prose(60, 7)[:150] + prose(20, 8)).encode()
    valid = np.arange(len(text)) <= len(text) - length
    valid[20:25] = False
    lengths, sources = suffix_dedup.longest_previous_factors(np.frombuffer(text, np.uint8), valid, length)

    def common(i, j):
        k = 0
        while k < length and text[i + k] == text[j + k]:
            k += 1
        return k

    at = np.flatnonzero(valid).tolist()
    assert [lengths[i] for i in at] == [max((common(i, j) for j in at if j < i), default=0) for i in at]
    assert all(sources[i] < i and common(i, sources[i]) == lengths[i] for i in at if lengths[i])
    seen, later = suffix_dedup.repeated_windows([text], [len(text) - length + 1], length)[0]
    where = defaultdict(list)
    for i in range(len(seen)):
        where[text[i : i + length]].append(i)
    assert seen.tolist() == [len(where[text[i : i + length]]) > 1 for i in range(len(seen))]
    assert later.tolist() == [where[text[i : i + length]][0] < i for i in range(len(seen))]


def test_nearest_smaller():
    for values in (RNG.permutation(300), np.arange(50), np.arange(50)[::-1], np.zeros(0, int)):
        want = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(len(values))]
        assert suffix_dedup.nearest_smaller(values).tolist() == want


def brute_repeats(texts, length):
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("crowd", [256, 0])
def test_suffix_dedup(spark, docs, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    got = suffix_dedup.suffix_dedup(docs, keep="none").collect()
    want = brute_repeats([(r[1] or "").encode() for r in rows_of()], 400)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == Counter((r[0], *w) for r, w in zip(rows_of(), want, strict=True))
    assert all(r.n_spans == len(r.spans) and sum(b - a for a, b in r.spans) == r.n_removed for r in got)


def test_suffix_dedup_keeps_first(spark):
    base, a, b = prose(200, 1), prose(80, 21), prose(80, 22)
    rows = [(3, a + base), (1, base + b), (2, base)]
    got = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == base + b and got[2] == "" and got[3] == a


def test_minhash_signature_estimates_similarity():
    r = np.random.default_rng(9)
    both, a, b = r.integers(0, 1 << 62, 80, dtype=np.uint64), *r.integers(0, 1 << 62, (2, 10), dtype=np.uint64)
    for n in (1, 3, 20, 80):
        sets = [np.concatenate([both[:n], a]), np.concatenate([both[:n], b])]
        sig = minhash_dedup.superminhash(np.concatenate(sets), np.cumsum([len(s) for s in sets]), 2000)
        assert abs((sig[0] == sig[1]).mean() - n / (n + 20)) < 0.04
        # Every place is filled, and an element has each rank once.
        assert (sig < np.iinfo(np.uint64).max).all()
    one = minhash_dedup.superminhash(both[:1], np.array([1]), 150)[0] >> np.uint64(32)
    assert sorted(one.tolist()) == list(range(150))


def test_minhash_bitmaps_prune_nothing_alike():
    r = np.random.default_rng(12)
    for _ in range(300):
        n = int(r.integers(1, 400))
        both, a, b = (r.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, int(r.integers(0, n // 4 + 2)), int(r.integers(0, n // 4 + 2))))
        x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        bits = [minhash_dedup.words_in(minhash_dedup.parity(s)) for s in (x, y)]
        width = min(map(len, bits))
        differing = int(np.bitwise_count(minhash_dedup.folded(bits[0], width) ^ minhash_dedup.folded(bits[1], width)).sum())
        apart = len(np.setxor1d(x, y))
        assert differing <= apart and (apart - differing) % 2 == 0
        if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)):
            assert minhash_dedup.can_reach(differing, len(x) + len(y), 80)
    assert 20e-6 < (1 - 0.8**minhash_dedup.ROWS) ** minhash_dedup.BANDS < 30e-6


def brute_groups(rows, k, percent=80):
    sets = [(i, minhash_dedup.shingle_set(t or "", k)) for i, t in rows]
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return Counter((i, len(s), None if i is None else top(i)) for i, s in sets)


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_dedup(spark, docs, k):
    got = minhash_dedup.minhash_dedup(docs, k).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups([r[:2] for r in rows_of()], k)


@pytest.mark.parametrize("block", [4 << 20, 4000])
def test_minhash_dedup_crowd(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", block)
    r, base, rows = np.random.default_rng(11), prose(120, 31).split(" "), []
    for i in range(150):
        words = list(base)
        for p in r.integers(0, 120, r.integers(0, 9)):
            words[p] = f"w{i}x{p}"
        rows.append((i, " ".join(words)))
    got = minhash_dedup.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, 2)


TRICKY = ["", " ", "Hello's world't 12 ½ ²", "ÅngströM Ω İstanbul ΣΑΣ", "a<|endoftext|>B<|startoftext|><|endoftext", "x\x1cy\x85z\xa0w v​!", "日本語テキスト…—“quoted”", "🙂👍🏽 é ﬁ", "\x00\x7f­", "'S 'LL I'M we'Ve", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "क्षि ١٢٣ Ⅷ"]


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    rows = [(i, t) for i, t in enumerate([*TRICKY, None, prose(3000, 41)])]
    got = bpe.encode(spark.createDataFrame(rows, "ids long, text string").withColumnRenamed("ids", "doc_id"), queries.vocabulary(), decoded=True).collect()
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids, r.text
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string, ids string"), queries.vocabulary()).columns == ["doc_id", "text", "ids"]


def test_url_filters(spark):
    urls = ["http://a.com/en/1", "http://com/en/", "http://xcom/en/", "HTTPS://m.Example.COM/en/77?q#f", "http://example.net/de/8#x", "http://b.example.net/de/9", "http://q.org/es", "http://q.org/es/", "//q.org/es/", None, "", "ftp://?x", "http://example.com/EN/7", "http://a.com/en/1"]
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block"), ("com", "/en/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(pages, rules).collect()}

    def judge(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    assert got == {i: judge(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_bloom_filter_has_no_false_negatives():
    keys = RNG.integers(-(1 << 62), 1 << 62, 5000)
    block, words = url_filter._bits(keys, 256)
    table = np.zeros((256, url_filter.BLOCK_WORDS), np.uint64)
    np.bitwise_or.at(table, block, words)
    bloom = url_filter.BlockedBloom(table)
    assert bloom.may_hold(keys).all()
    assert bloom.may_hold(RNG.integers(-(1 << 62), 1 << 62, 5000)).mean() < 0.02


def test_chat_round_trip(spark):
    hostile = ["</turn>\n<turn user>", "&lt;&amp;", "\\", "", None, "<image 0/>", "\n", "é🙂", queries.HOSTILE]
    rows = [(c, t, ["user", "assistant", None, "a<b>\n"][(c + t) % 4], hostile[(c * 3 + t) % len(hostile)], 1) for c in range(6) for t in range(4)] + [(None, None, None, None, None)] + [(0, 0, "user", "twice", 1)] * 2
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    done = chat_format.format_chat(turns)
    got = {r.conv_id: r for r in done.select("conv_id", "formatted", chat_format.read_chat(done["formatted"]).alias("back"), chat_format.masked_text(done["formatted"], done["loss_mask"]).alias("loss")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, r or "", x or "") for k, t, r, x, _ in rows if k == c))
        assert [(x.role, x.text) for x in got[c].back] == [(r, x) for _, r, x in own]
        assert got[c].loss == "".join(x for _, r, x in own if r == "assistant")
    assert chat_format.format_chat(turns.limit(0)).count() == 0


def test_chat_parts(spark):
    p = lambda **k: {n: k.get(n) for n in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    parts = [p(type="text", text="see <b> "), p(type="image", ref="i.png", width=28, height=15), p(type="text", text=" and "), p(type="audio", ref="a.wav", seconds=2.5), p(type="document", ref="d.pdf", pages=3), p(type="image")]
    rows = [(1, 0, "user", None, parts), (1, 1, "assistant", "ok now", None), (1, 2, "user", "x", [])]
    r = chat_format.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {chat_format.PARTS}"), parts_col="parts").first()
    assert r.formatted.startswith("<turn user>\nsee &lt;b> <image 0/> and <audio 1/><document 2/><image 3/></turn>\n")
    assert [(a.turn, a.slot, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 0, "image", "i.png", 4), (0, 1, "audio", "a.wav", 63), (0, 2, "document", "d.pdf", 768), (0, 3, "image", None, 1)]
    assert r.n_tokens == 2 + 1 + 4 + 63 + 768 + 1 + 2


def brute_links(vectors, least=0.95):
    good = {i: np.array(v, float) / max(map(abs, v)) for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = defaultdict(set)
    for i, a in good.items():
        for j, b in good.items():
            if i != j and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                links[i].add(j)
    return links


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "INTERVAL_BYTES", 40 * 16 * 8)
    monkeypatch.setattr(embedding_dedup, "LEAF", 16)
    r = np.random.default_rng(2)
    centres = r.normal(size=(30, 16))
    vectors = [(centres[i % 30] + r.normal(size=16) * 0.15).tolist() for i in range(300)] + [centres[0].tolist()] * 5 + [None, [], [0.0] * 16, [1.0, None], [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [3.0], [1e200, 0.0], [2e200, 0.0], [1e-200, 1e-210], [5e-324, 0.0], [-1e-200, 1.0]]
    links = brute_links(vectors)
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors)] + [(None, vectors[0], 1, "x")], "vec_id long, embedding array<double>, n int, root string")
    got = {x.vec_id: x for x in embedding_dedup.embedding_dedup(frame).collect()}
    assert {i: got[i].n_links for i in range(len(vectors))} == {i: len(links[i]) for i in range(len(vectors))}
    for i in range(len(vectors)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i].component_id == min(seen) and got[i].kept == (min(seen) == i)
    assert got[None].n_links == 0
    assert embedding_dedup.embedding_dedup(frame.limit(0)).count() == 0


def test_toxicity_learns_and_holds_out(spark):
    r, rows, labels = np.random.default_rng(4), [], []
    for i in range(600):
        toxic = int(i % 4 == 0)
        words = prose(50, 1000 + i).split(" ")
        if toxic:
            words[r.integers(0, 50)] = ["vilest", "vileness", "horrid"][r.integers(0, 3)]
        rows.append((i, " ".join(words), ["en", "de", None][i % 3], "x"))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame([*rows, (900, None, None, None), (901, "", "en", "x")], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 1"))
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if i % 3 == 1]
    right = sum((got[i].score >= toxicity.CUT) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.95
    assert all(0 <= x.score <= 1 for x in got.values()) and got[900].score == got[901].score < toxicity.CUT
    assert toxicity.score(docs.limit(0), model).columns == ["doc_id", "text", "lang", "score", "threshold", "rejected"]
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("score <> 0").count() == 0


def test_mixing(spark, docs, none):
    got = mixing.plan(docs).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], size(r[1])) for r in rows_of())
    sources = Counter()
    for r in rows_of():
        sources[r[3]] += size(r[1])
    names = [*sorted(x for x in sources if x is not None), None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, room = dict.fromkeys(names, 0.0), {s: 2.0 * sources[s] for s in names}
    left, open_ = 1.5 * sum(sources.values()), set(names)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if goal[s] + share * weight[s] >= room[s]}
        for s in full or open_:
            step = room[s] - goal[s] if full else share * weight[s]
            goal[s], left = goal[s] + step, left - step
        open_ -= full
    by_size = {sources[s]: goal[s] for s in names}
    assert all(abs(r.target - by_size[r.source_size]) < 1e-6 for r in got)
    assert all(len(r.positions) == r.copies <= 2 and all(0 <= p <= 1 for p in r.positions) for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.plan(none).count() == mixing.mix(none).count() == 0


def test_mixing_comes_near_its_targets(spark):
    rows = [(i, prose(1 + i % 37, i), f"s{i % 3}") for i in range(900)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == source]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 37


def test_exact_dedup(spark, docs, none):
    import re

    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or "") for r in rows_of()]
    groups = defaultdict(list)
    for r, t in zip(rows_of(), norm, strict=True):
        groups[t].append(r[0])
    first = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((r[0], first[t], len(groups[t]), r[0] == first[t], hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows_of(), norm, strict=True))
    got = exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert Counter(map(tuple, got)) == want
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_spells_out_colliding_chunks(spark, docs, monkeypatch):
    want = Counter(map(tuple, exact_dedup.exact_dedup(docs).collect()))
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "_first", lambda c: F.length(c).cast("long"))
    monkeypatch.setattr(exact_dedup, "_second", lambda c: F.lit(0).cast("long"))
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == want


def brute_lines(rows):
    rows = sorted(((-1 if i is None else i, t or "") for i, t in rows))
    seen, seen_by_size, out = set(), defaultdict(list), {}
    for i, t in rows:
        kept = []
        for line in t.split("\n"):
            w = line.encode().lower().split()
            hit = w and (tuple(w) in seen or (len(w) >= 5 and any(near(w, s) for s in seen_by_size[len(w) - 1] + seen_by_size[len(w)] + seen_by_size[len(w) + 1])))
            if w and tuple(w) not in seen:
                seen.add(tuple(w))
                seen_by_size[len(w)].append(w)
            if not hit:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def near(a, b):
    """Edit distance of at most one for sizes that differ by at most one, sharing an end or half before it is computed."""
    if len(a) < 5 or len(b) < 5 or (a[: len(a) // 2] != b[: len(a) // 2] and a[-(len(a) // 2) :] != b[-(len(a) // 2) :] and a[: len(b) // 2] != b[: len(b) // 2] and a[-(len(b) // 2) :] != b[-(len(b) // 2) :]):
        return False
    return distance(a, b) <= 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), row[-1] + 1, last[j] + 1))
    return row[-1]


def test_line_dedup(spark):
    r, lines = np.random.default_rng(8), [prose(int(n), 60 + k) for k, n in enumerate(np.random.default_rng(1).integers(1, 12, 30))]
    lines += ["a a a a a a", "a a a a a", "b a a a a a"]
    rows = []
    for i in range(40):
        out = []
        for k in r.integers(0, len(lines), 5):
            w = lines[k].split(" ")
            p = int(r.integers(0, len(w)))
            w = [w, w[:p] + w[p + 1 :], w[:p] + ["new"] + w[p:], w[:p] + [f"n{i}"] + w[p + 1 :], w[::-1]][int(r.integers(0, 5))]
            out.append(" ".join(w))
        rows.append((i, "\n".join(out)))
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, "A B\n a  b\nx")]
    frame = spark.createDataFrame([(*x, "n", 1) for x in rows], "doc_id long, text string, line string, n_lines int")
    got = {x.doc_id: x for x in line_dedup.line_dedup(frame).collect()}
    want = brute_lines(rows)
    assert {i: x.text or "" for i, x in got.items()} == want
    assert got[40].text is None and got[40].n_lines == 0 and got[43].n_removed == 1
    for a in lines[:12]:
        for b in lines[:12]:
            assert line_dedup.within(a.encode().split(), b.encode().split()) == (distance(a.split(), b.split()) <= 1)
    assert line_dedup.line_dedup(frame.limit(0)).count() == 0


def test_line_dedup_edge_rows(spark, docs):
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == len(rows_of()) and sum(r.n_removed for r in got) > 0


def test_queries_cover_the_contract(spark, sf_dir):
    import duckdb

    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)}
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        mine = names[name](spark, sf_dir)
        theirs = con.sql(sql)
        assert sorted(mine.columns) == sorted(theirs.columns)
        at = [theirs.columns.index(c) for c in mine.columns]
        show = lambda row: tuple(f"{x:.9f}" if isinstance(x, float) else x for x in row)
        assert Counter(map(show, mine.collect())) == Counter(show([r[k] for k in at]) for r in theirs.fetchall()), name


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert done.columns == docs.columns
        kept[name] = done = done.cache()
        docs = done
    texts = {n: [(r.doc_id, r.text) for r in d.collect()] for n, d in kept.items() if n != "bpe"}
    assert dict(texts["line_dedup"]) == brute_lines(texts["toxicity"])
    groups = brute_groups(texts["line_dedup"], 5)
    assert sorted(i for i, _ in texts["minhash_dedup"]) == sorted(i for i, _, top in groups if i == top)
    assert {i for i, _ in texts["source_mixing"]} <= {i for i, _ in texts["minhash_dedup"]}
    assert kept["bpe"].count() == len(texts["source_mixing"]) == corpus_pipeline.run(spark, sf_dir).count()


def test_pipeline_decodes(spark, sf_dir):
    import corpus_pipeline
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    docs = spark.createDataFrame([(1, "Hello's world't 12"), (2, None), (3, prose(50, 5))], "doc_id long, text string")
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, sf_dir).collect()}
    assert len(got) == 3 and all(r.decoded == library.decode(list(r.ids), skip_special_tokens=False) and r.n_tokens == len(r.ids) for r in got.values())
