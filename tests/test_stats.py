import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from farewise.functions import stats


@pytest.mark.parametrize("p,df,expected", [(0.975, 1, 12.7062047), (0.975, 5, 2.5705818), (0.975, 30, 2.0422725), (0.95, 10, 1.8124611), (0.995, 120, 2.6174211), (0.025, 5, -2.5705818), (0.5, 7, 0.0)])
def test_t_quantiles_match_tables(p, df, expected):
    assert float(stats.t_quantile(p, df)) == pytest.approx(expected, abs=1e-6)


def test_normal_quantile():
    assert stats.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-9)


def pmf(n, p):
    return np.array([math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)])


@pytest.mark.parametrize("n", [1, 2, 5, 17, 40])
@pytest.mark.parametrize("p", [0.05, 0.3, 0.5, 0.95])
def test_binomial_tests_match_enumeration(n, p):
    mass, k = pmf(n, p), np.arange(n + 1)
    two = [min(1.0, mass[mass <= mass[i] * (1 + 1e-7)].sum()) for i in k]
    np.testing.assert_allclose(stats.binomial_p_value(k, n, p), two, atol=1e-10)
    np.testing.assert_allclose(stats.binomial_p_value(k, n, p, "less"), np.cumsum(mass), atol=1e-10)
    np.testing.assert_allclose(stats.binomial_p_value(k, n, p, "greater"), np.cumsum(mass[::-1])[::-1], atol=1e-10)


def test_column_functions_keep_nulls_and_edges(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (5, 10), (0, 0), (None, 4)], "k int, n int")
    got = df.select("k", "n", stats.clopper_pearson("k", "n").alias("b"), stats.binom_test("k", "n", 0.5).alias("p"), stats.t_ppf(0.975, "n").alias("t")).collect()
    by = {(r["k"], r["n"]): r for r in got}
    assert by[(0, 10)]["b"]["lower"] == 0 and by[(0, 10)]["b"]["upper"] == pytest.approx(0.3084971, abs=1e-6)
    assert by[(10, 10)]["b"]["upper"] == 1 and by[(10, 10)]["b"]["lower"] == pytest.approx(0.6915029, abs=1e-6)
    assert by[(5, 10)]["b"]["lower"] == pytest.approx(0.1870860, abs=1e-6) and by[(5, 10)]["p"] == pytest.approx(1.0)
    assert by[(0, 0)]["b"]["lower"] is None and by[(0, 0)]["p"] is None and by[(0, 0)]["t"] is None
    assert by[(None, 4)]["b"]["lower"] is None and by[(None, 4)]["p"] is None


def test_holm_by_hand(spark):
    df = spark.createDataFrame([("a", 1, 0.01), ("a", 2, 0.04), ("a", 3, 0.03), ("a", 4, None), ("b", 1, 0.2), ("b", 2, 0.2), ("b", 3, 0.9)], "f string, i int, p double")
    got = {(r["f"], r["i"]): r["p_holm"] for r in stats.holm_adjust(df, "p", ["f"]).collect()}
    assert got[("a", 1)] == pytest.approx(0.03) and got[("a", 2)] == pytest.approx(0.06) and got[("a", 3)] == pytest.approx(0.06)
    assert got[("a", 4)] is None and got[("b", 1)] == got[("b", 2)] == pytest.approx(0.6) and got[("b", 3)] == pytest.approx(0.9)


def test_p_values_do_not_depend_on_their_batch():
    k, n = np.array([5376, 5368, 5270, 5372, 5379, 5404]), 5647
    whole = stats.binomial_p_value(k, n, 0.95, "less")
    assert whole.tolist() == [float(stats.binomial_p_value(x, n, 0.95, "less")) for x in k]
    i = np.arange(340_000 - 1500)
    log = np.array([math.lgamma(340_001) - math.lgamma(j + 1) - math.lgamma(340_001 - j) for j in i[-20_000:]]) + i[-20_000:] * math.log(0.995) + (340_000 - i[-20_000:]) * math.log(0.005)
    assert float(stats.binomial_p_value(i[-1], 340_000, 0.995, "less")) == pytest.approx(np.exp(log).sum(), rel=1e-6)


def test_holm_meets_p_values_that_change_when_computed_again(spark):
    @F.pandas_udf("double")
    def noisy(i: pd.Series) -> pd.Series:
        return (i + 1) / 100 * (1 + 1e-15 * np.random.default_rng().integers(0, 50, len(i)))

    df = spark.range(40).select("id", noisy.asNondeterministic()("id").alias("p"))
    got = stats.holm_adjust(df, "p", []).toPandas()
    assert len(got) == 40 and got.p_holm.notna().all()
