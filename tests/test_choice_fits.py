import numpy as np
import pandas as pd
import pytest
from test_evaluate import choices, reference_fit

from farewise.operators import choice_fits, mnl


@pytest.fixture(scope="module")
def table():
    """Two sound keys of unlike size, one named by NULL, and keys that fail each in their own way."""
    parts = [choices(2500, 2), choices(600, 5), choices(400, 7), choices(300, 9)]
    for pdf, name in zip(parts, ("big", None, "flat", "never"), strict=True):
        pdf["market"] = name
    for j in range(3):
        parts[2][f"tt{j}"] = 50.0
    parts[3] = parts[3][parts[3].choice_index != 2]
    return parts


def test_keys_fitted_together_equal_fits_alone(spark, table):
    df = mnl.choice_features(spark.createDataFrame(pd.concat(table)))
    fits = {r["market"]: r for r in choice_fits.fit_mnl_by(df, ["market"]).collect()}
    assert {k: r["status"] for k, r in fits.items()} == {"big": "ok", None: "ok", "flat": "rank_deficient", "never": "missing_alternative"}
    for pdf in table[:2]:
        row = fits[pdf.market.iloc[0]]
        alone = mnl.fit_mnl(mnl.choice_features(spark.createDataFrame(pdf.drop(columns="market"))))
        np.testing.assert_allclose(row["beta"], alone["beta"], atol=1e-9)
        np.testing.assert_allclose(row["beta"], reference_fit(pdf), atol=1e-5)
        np.testing.assert_allclose(row["standard_errors"], alone["standard_errors"], rtol=1e-8)
        assert (row["n"], row["steps"]) == (len(pdf), alone["steps"]) and row["log_likelihood"] == pytest.approx(alone["log_likelihood"])
    assert all(fits[k][c] is None for k in ("flat", "never") for c in ("beta", "standard_errors", "log_likelihood"))


def test_no_rows_no_keys_and_too_few_steps(spark, table):
    df = mnl.choice_features(spark.createDataFrame(table[0]))
    assert choice_fits.fit_mnl_by(df.limit(0), ["market"]).count() == 0
    row = choice_fits.fit_mnl_by(df, ["market"], max_steps=2).first()
    assert row["status"] == "not_converged" and row["beta"] is None
