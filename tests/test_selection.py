"""Selection of ranks against sorting."""

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from landlens.operators import selection


@pytest.mark.parametrize("small", [4096, 20])
def test_ranks_and_quantiles_equal_sorting(spark, monkeypatch, small):
    monkeypatch.setattr(selection, "SMALL", small)
    monkeypatch.setattr(selection, "BINS", 64)
    rng = random.Random(1)
    groups = {"even": [rng.random() for _ in range(300)], "same": [2.5] * 300, "two": [1.0] * 200 + [9.0], "steep": [10.0**k for k in range(-300, 300, 100)], "wide": [-1.7e308, 0.0, 1.7e308, -0.0, 5e-324], "one": [3.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("even", float("nan")), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.q for r in selection.quantiles(df, ["g"], "v", [0.0, 0.02, 0.5, 0.98, 1.0]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        if g != "wide":
            assert got[g] == pytest.approx(np.quantile(vs, [0.0, 0.02, 0.5, 0.98, 1.0]).tolist())
        assert got[g][2] == pytest.approx(median(vs))
    ranks = selection.select_ranks(df, ["g"], "v", lambda n: [n - 1, F.lit(0), F.floor(n / 3)])
    for r in ranks.collect():
        vs = sorted(groups[r.g])
        assert r.n == len(vs) and all(vs[k] == v for k, v in r["at"].items()) and {0, len(vs) - 1, len(vs) // 3} == set(r["at"])
    assert selection.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
