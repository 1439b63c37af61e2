"""Protocols of the models that stay outside, and how they run over columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Texts or images to vectors of one length."""

    def embed(self, items: Sequence) -> Sequence[Sequence[float]]: ...


class Generator(Protocol):
    """Prompts to texts, with a cap on tokens by purpose."""

    def generate(self, prompts: Sequence[str], purpose: str) -> Sequence[str]: ...


class Reranker(Protocol):
    """Scores in [0, 1] of (question, document text) pairs."""

    def score(self, pairs: Sequence[tuple[str, str]]) -> Sequence[float]: ...


def embedded(column: Column, make, batch: int = 32) -> Column:
    """Vectors of a column; make() builds the model once a task; an item that fails alone has a null vector."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()

        def one(x):
            try:
                return list(model.embed([x])[0])
            except Exception:  # noqa: BLE001
                return None

        for s in batches:
            out: list = []
            for k in range(0, len(s), batch):
                part = list(s[k : k + batch])
                try:
                    out += [list(v) for v in model.embed(part)]
                except Exception:  # noqa: BLE001
                    out += [one(x) for x in part]
            yield pd.Series(out)

    return run(column)


def generated(prompt: Column, make, purpose: str) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            yield pd.Series(list(model.generate(list(s), purpose)))

    return run(prompt)


def reranked(question: Column, text: Column, make) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in batches:
            yield pd.Series([float(x) for x in model.score(list(zip(q, t, strict=True)))])

    return run(question, text)
