import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from farewise.functions import skew
from farewise.functions.skew import Quantile, exact_quantiles, with_neighbour, with_running_max


@pytest.fixture(scope="module")
def skewed(spark):
    """One group of 120,000 rows (ties included) beside many tiny ones."""
    rng = np.random.default_rng(3)
    hot = pd.DataFrame({"k": 0, "v": np.r_[rng.lognormal(size=90_000), np.round(rng.normal(size=30_000), 1)]})
    cold = pd.DataFrame({"k": rng.integers(1, 400, 3_000), "v": rng.normal(size=3_000).round(2)})
    pdf = pd.concat([hot, cold], ignore_index=True)
    pdf["ok"] = rng.random(len(pdf)) < 0.8
    return pdf, spark.createDataFrame(pdf).repartition(8).cache()


WANTED = [Quantile("p5", "v", 0.05, "ok"), Quantile("p50", "v", 0.5, "ok"), Quantile("p90", "v", 0.9, "ok"), Quantile("all90", "v", 0.9)]


def test_quantiles_are_exact_for_hot_and_cold_groups(skewed):
    pdf, df = skewed
    got = exact_quantiles(df, ["k"], WANTED, [F.count("*").alias("n")]).toPandas().set_index("k").sort_index()
    valid = pdf[pdf.ok].groupby("k").v
    for name, q in (("p5", 0.05), ("p50", 0.5), ("p90", 0.9)):
        expected = valid.quantile(q).reindex(got.index)
        np.testing.assert_allclose(got[name].to_numpy(float), expected.to_numpy(float), atol=1e-12)
    np.testing.assert_allclose(got.all90, pdf.groupby("k").v.quantile(0.9).reindex(got.index), atol=1e-12)
    assert (got.n == pdf.groupby("k").size().reindex(got.index)).all()


@pytest.mark.parametrize("limit", [0, 5, 10**9])
def test_small_and_large_groups_take_ways_that_agree(skewed, monkeypatch, limit):
    pdf, df = skewed
    part = df.filter("k < 40 and (k > 0 or v > 1.5)").withColumn("k", F.nullif("k", F.lit(3)))
    monkeypatch.setattr(skew, "EXACT_ROWS", limit)
    got = exact_quantiles(part, ["k"], WANTED, [F.count("*").alias("n")]).toPandas().set_index("k").sort_index()
    frame = part.toPandas()
    valid = frame[frame.ok].groupby("k", dropna=False).v
    np.testing.assert_allclose(got.p50.to_numpy(float), valid.median().reindex(got.index).to_numpy(float), atol=1e-12)
    np.testing.assert_allclose(got.all90, frame.groupby("k", dropna=False).v.quantile(0.9).reindex(got.index), atol=1e-12)


def test_global_quantile_without_keys(skewed):
    pdf, df = skewed
    got = exact_quantiles(df, [], WANTED[-1:]).first()[0]
    assert got == pytest.approx(pdf.v.quantile(0.9), abs=1e-12)


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(5)
    n = 4_000
    who = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 200, n))
    pdf = pd.DataFrame({"who": who, "t": rng.integers(0, 5_000, n), "i": np.arange(n), "end": rng.integers(0, 6_000, n)})
    return pdf, spark.createDataFrame(pdf).repartition(8).cache()


@pytest.mark.parametrize("ahead", [True, False])
def test_neighbours_cross_piece_boundaries(log, ahead):
    pdf, df = log
    out = with_neighbour(df, ["who"], ["t", "i"], F.floor(F.col("t") / 300), ["i"], "near", ahead)
    got = {r["i"]: r["n"] for r in out.select("i", F.col("near.i").alias("n")).collect()}
    ordered = pdf.sort_values(["who", "t", "i"])
    shifted = ordered.groupby("who").i.shift(-1 if ahead else 1)
    assert got == {int(i): None if pd.isna(s) else int(s) for i, s in zip(ordered.i, shifted)}


def test_running_max_crosses_piece_boundaries(log):
    pdf, df = log
    out = with_running_max(df, ["who"], ["t", "i"], F.floor(F.col("t") / 300), "end", "top")
    got = {r["i"]: r["top"] for r in out.select("i", "top").collect()}
    ordered = pdf.sort_values(["who", "t", "i"])
    before = ordered.groupby("who").end.cummax().groupby(ordered.who).shift(1)
    assert got == {int(i): None if pd.isna(s) else int(s) for i, s in zip(ordered.i, before)}
