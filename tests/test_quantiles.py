"""Exact quantiles by selection against numpy."""

import numpy as np
import pytest

from paperlake.operators import analytics as S


@pytest.mark.parametrize(("accuracy", "kind"), [(10_000, "normal"), (200, "normal"), (100, "ties"), (50, "skewed")])
def test_quantiles(spark, monkeypatch, accuracy, kind):
    monkeypatch.setattr(S, "ACCURACY", accuracy)
    r = np.random.default_rng(accuracy)
    make = {"normal": lambda n: r.normal(size=n), "ties": lambda n: r.integers(0, 4, n).astype(float), "skewed": lambda n: np.exp(6 * r.normal(size=n)).round()}[kind]
    groups = {"a": make(3000), "b": make(7), None: make(400), "one": make(1)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    probs = [0.25, 0.5, 0.75, 0.0, 1.0, 0.999]
    got = {x.g: x.q for x in S.quantiles(df, "x", probs, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g] == pytest.approx(np.quantile(v, probs), rel=1e-12)
    every = np.concatenate(list(groups.values()))
    assert S.quantiles(df, "x", probs).first().q == pytest.approx(np.quantile(every, probs), rel=1e-12)
    if accuracy == 50:
        assert S.quantiles(df.limit(0), "x", probs).first().q is None and S.quantiles(df.limit(0), "x", probs, ["g"]).count() == 0


def test_a_bracket_that_misses_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(S, "BRACKET", -2000)
    with pytest.raises(Exception, match="misses the rank"):
        S.quantiles(spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS x"), "x", [0.5]).collect()
