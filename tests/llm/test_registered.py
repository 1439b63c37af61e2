"""The registered queries without SQL, over whole tables, against independent recomputations."""

import hashlib
import shutil
import zlib

import pytest

from paperlake.llm import queries

from .test_llm import brute_groups, brute_lines, brute_repeats


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_op1(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in queries.op1_suffix_dedup(spark, sf_dir).collect()}
    want = brute_repeats([t.encode() for _, t in texts], 400)
    assert got == {i: (n, gone, sha(left)) for (i, _), (n, gone, left) in zip(texts, want, strict=True)}
    assert any(gone for _, gone, _ in got.values())


def test_op2(spark, sf_dir, texts):
    got = queries.op2_minhash_dedup(spark, sf_dir).collect()
    assert brute_groups(texts, 2) == {(r.doc_id, r.n_shingles, r.component_id): 1 for r in got}
    assert len(got) == len(texts) and all(r.kept == (r.doc_id == r.component_id) for r in got) and not all(r.kept for r in got)


def test_op3(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    got = {r.doc_id: tuple(r) for r in queries.op3_bpe(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i] == (i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(library.decode(ids, skip_special_tokens=False).encode()))


def test_op7(spark, sf_dir, texts, tmp_path):
    got = queries.op7_toxicity(spark, sf_dir).collect()
    held = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in texts)
    assert {r.doc_id for r in got if r.held_out} == held
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    # Labels of held-out rows, languages and sources play no part in any score.
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs.selectExpr("doc_id", "text", "'xx' AS lang", "'other' AS source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    flipped = "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - toxic ELSE toxic END"
    labels.selectExpr("doc_id", f"{flipped} AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    again = {r.doc_id: r.score for r in queries.op7_toxicity(spark, str(tmp_path)).collect()}
    assert again == pytest.approx({r.doc_id: r.score for r in got}, abs=1e-9)
    shutil.rmtree(tmp_path)


def test_op10(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in queries.op10_line_dedup(spark, sf_dir).collect()}
    want = brute_lines(texts)
    count = lambda t: t.count("\n") + 1
    assert {i: h for i, (_, h) in got.items()} == {i: sha(t.encode()) for i, t in want.items()}
    assert all(n == count(t) - count(want[i]) for i, t in texts if want[i] for n in [got[i][0]])


def test_no_query_reads_a_part(spark, sf_dir, texts):
    for name in ("op1_suffix_dedup", "op8_source_mixing", "op9_exact_dedup"):
        rows = queries.queries()[name](spark, sf_dir).select("doc_id").collect()
        assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in texts), name
