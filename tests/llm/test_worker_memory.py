"""What operators leave in the Python workers, which live through all stages of a session and count against an executor's memory."""

import sys

import numpy as np
import psutil
import pyarrow as pa
import pytest

from paperlake.llm import bpe, minhash_dedup, queries, toxicity
from paperlake.llm.common import tidy

TEXTS = [(1, "one two three"), (2, None), (3, "you damned fool"), (4, "")]


def left_in_workers(spark):
    def run(batches):
        for b in batches:
            held = sys.modules.get("_paperlake_worker")
            yield pa.RecordBatch.from_pydict({"kept": [held.__dict__.get("kept", ("", None))[0] if held else ""] * len(b)})

    return {r["kept"] for r in spark.range(0, 40, 1, 8).mapInArrow(run, "kept string").collect()}


def test_an_operator_drops_what_an_earlier_one_left(spark):
    docs = spark.createDataFrame(TEXTS * 4, "doc_id long, text string").repartition(8)
    bpe.encode(docs, queries.vocabulary()).collect()
    assert any(k.startswith("bpe ") for k in left_in_workers(spark))
    # The two workers that a core has at most all see tasks of the next operator.
    for _ in range(4):
        minhash_dedup.signatures(docs, 2, "doc_id", "text").collect()
    assert not any(k.startswith("bpe ") for k in left_in_workers(spark))


@pytest.mark.skipif(sys.platform != "linux", reason="other allocators")
def test_freed_memory_goes_back_at_the_end_of_a_task():
    used = lambda: psutil.Process().memory_info().rss >> 20
    pins, at_work = [], []

    def run(batches):
        held = [np.ones(8_000) for _ in range(3_000)]  # 192 MB in pieces that the allocator does not map one by one
        pins.append(np.ones(8_000))  # and one behind them, so that the heap cannot shrink from its end
        at_work.append(used())
        held.clear()
        yield from batches

    assert list(tidy(run)(iter([1, 2]))) == [1, 2]
    assert at_work[0] - used() > 150


def test_scoring_sends_a_text_once(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, lang_col=None, epochs=1)
    scored = toxicity.score(docs, model, lang_col=None)
    sent = scored._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1].splitlines()[1]
    assert sent.count("text") == 2, sent  # as the name and the value of a field, in no column of its own
    beside = toxicity.score(docs, model, lang_col=None, carry=["doc_id"])
    whole = {r["doc_id"]: (r["text"], r["score"]) for r in scored.collect()}
    assert {k: t for k, (t, _) in whole.items()} == dict(TEXTS)
    assert {k: s for k, (_, s) in whole.items()} == {r["doc_id"]: r["score"] for r in beside.collect()}
    assert whole[2][1] == whole[4][1]
