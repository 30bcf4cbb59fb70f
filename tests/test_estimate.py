import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from farewise.operators import choice, draws, estimate, inference, keyed, resample
from farewise.sources.tables import ContractError

THETA = np.array([[-0.60, 0.15], [0.12, -0.50]])
ZONES = [0, 1, 2]
CONTROLS = choice.feature_names(ZONES)


def frame(seed=1, noise=0.0, days=14):
    rng = np.random.default_rng(seed)
    grid = pd.MultiIndex.from_product([ZONES, range(days), range(0, 24, 3)], names=["zone_id", "day", "hr"]).to_frame(index=False)
    grid["day_id"] = pd.to_datetime("2024-01-01") + pd.to_timedelta(grid.day, "D")
    grid["weekday"] = grid.day_id.dt.weekday
    grid["is_weekend"] = (grid.weekday >= 5).astype(int)
    grid["is_peak"] = grid.hr.isin([9, 18]).astype(int)
    grid["hour_sin"], grid["hour_cos"] = np.sin(2 * np.pi * grid.hr / 24), np.cos(2 * np.pi * grid.hr / 24)
    grid["distance_scaled"] = rng.random(len(grid))
    for s in "xy":
        grid[f"multiplier_{s}"] = rng.choice([0.9, 1.0, 1.1], len(grid))
        grid[f"log_multiplier_{s}"] = np.log(grid[f"multiplier_{s}"])
    grid["n_sessions"] = rng.integers(20, 80, len(grid))
    base_x = 0.35 + 0.02 * grid.zone_id + 0.03 * grid.hour_sin + 0.02 * (grid.weekday == 2) + 0.05 * grid.distance_scaled
    base_y = 0.25 - 0.01 * grid.zone_id + 0.02 * grid.is_peak
    t = grid[["log_multiplier_x", "log_multiplier_y"]].to_numpy()
    for j, (s, base) in enumerate((("x", base_x), ("y", base_y))):
        grid[f"b_{s}"] = base
        grid[f"q_{s}"] = base + t @ THETA[j] + noise * rng.normal(size=len(grid))
    grid["fold"] = grid.day % 4
    grid["day_id"] = grid.day_id.dt.date
    return grid


@pytest.fixture(scope="module")
def exact(spark):
    pdf = frame()
    return pdf, choice.encode(spark.createDataFrame(pdf), ZONES).cache()


@pytest.fixture(scope="module")
def noisy(spark):
    pdf = frame(2, 0.05)
    return pdf, choice.encode(spark.createDataFrame(pdf), ZONES).cache()


def design(pdf):
    columns = [np.ones(len(pdf)), pdf.hour_sin, pdf.hour_cos, pdf.is_peak, pdf.distance_scaled]
    columns += [(pdf.zone_id == z) for z in ZONES[1:]] + [(pdf.weekday == d) for d in range(1, 7)]
    return np.column_stack([pdf.log_multiplier_x, pdf.log_multiplier_y, *columns]).astype(float)


@pytest.mark.parametrize("kind", ["adjusted_ols", "contrast_ols"])
def test_exact_blocks_return_the_true_effects(exact, kind):
    _, df = exact
    model = estimate.fit_ols(df, CONTROLS, kind)
    np.testing.assert_allclose(model.theta, THETA, atol=1e-8)
    assert model.ok and model.rank == 2
    predicted = estimate.predict_choice(df, model)
    assert predicted.filter("abs(p_x - q_x) > 1e-8 or abs(p_y - q_y) > 1e-8").count() == 0
    assert estimate.validation_rmse(df, model).first()[0] < 1e-8


def test_weighted_fit_equals_direct_least_squares(noisy):
    pdf, df = noisy
    x, w = design(pdf), np.sqrt(pdf.n_sessions.to_numpy(float))
    beta = np.linalg.lstsq(x * w[:, None], pdf[["q_x", "q_y"]].to_numpy() * w[:, None], rcond=None)[0]
    np.testing.assert_allclose(estimate.fit_ols(df, CONTROLS).theta, beta[:2].T, atol=1e-9)
    naive = np.column_stack([x[:, :2], np.ones(len(x))])
    beta = np.linalg.lstsq(naive * w[:, None], pdf[["q_x", "q_y"]].to_numpy() * w[:, None], rcond=None)[0]
    np.testing.assert_allclose(estimate.fit_ols(df, CONTROLS, "naive_ols").theta, beta[:2].T, atol=1e-9)


def test_constant_and_collinear_prices_are_not_identified(exact):
    _, df = exact
    fixed = df.withColumns({"log_multiplier_x": F.lit(0.0), "log_multiplier_y": F.lit(0.1)})
    assert estimate.fit_ols(fixed, CONTROLS).status == "not_identified"
    line = df.withColumn("log_multiplier_y", F.col("log_multiplier_x") * 2)
    assert estimate.fit_ols(line, CONTROLS).status == "not_identified"
    contrast = estimate.fit_ols(line, CONTROLS, "contrast_ols")
    assert contrast.ok and contrast.rank == 1
    np.testing.assert_allclose(np.abs(contrast.basis.ravel()), np.array([1, 2]) / np.sqrt(5), atol=1e-8)
    one = estimate.fit_ols(df.withColumn("log_multiplier_y", F.lit(0.1)), CONTROLS)
    assert one.ok and one.active == (0,) and one.constants[1] == pytest.approx(0.1)


def test_dml_recovers_effects_when_cells_carry_the_base(spark):
    pdf = frame(4)
    cell = pdf.zone_id * 0.02 + pdf.hr * 0.003
    t = pdf[["log_multiplier_x", "log_multiplier_y"]].to_numpy()
    pdf["q_x"], pdf["q_y"] = 0.3 + cell + t @ THETA[0], 0.2 - cell + t @ THETA[1]
    df = choice.encode(spark.createDataFrame(pdf), ZONES)
    model = estimate.fit_dml(df, CONTROLS, "fold")
    np.testing.assert_allclose(model.theta, THETA, atol=1e-8)


def test_dml_moments_equal_row_residuals(noisy):
    pdf, df = noisy
    rows = estimate.residualize(df, ["zone_id", "hr"], "fold").toPandas()
    assert len(rows) == len(pdf)
    r, w = rows[["r_tx", "r_ty", "r_yx", "r_yy"]].to_numpy(), rows.n_sessions.to_numpy(float)
    direct = np.linalg.solve(r[:, :2].T @ (r[:, :2] * w[:, None]), r[:, :2].T @ (r[:, 2:] * w[:, None])).T
    np.testing.assert_allclose(estimate.fit_dml(df, CONTROLS, "fold").theta, direct, atol=1e-9)


def test_hc3_and_day_clusters_equal_numpy(noisy):
    pdf, df = noisy
    gram, active, constants = estimate.collect_gram(df, CONTROLS)
    model = estimate.fit_from_gram(gram, "adjusted_ols", active, constants)
    x, w = design(pdf), pdf.n_sessions.to_numpy(float)
    inverse = np.linalg.inv(x.T @ (x * w[:, None]))
    y = pdf[["q_x", "q_y"]].to_numpy()
    residual = y - x @ (inverse @ x.T @ (y * w[:, None]))
    load = (x * w[:, None]) @ inverse
    h = np.einsum("ij,ij->i", x, load)
    expected = [(((load[:, k] * residual[:, j] / (1 - h)) ** 2).sum()) for j in range(2) for k in range(2)]
    cov = inference.hc3_covariance(df, model, gram)
    size = 1 + len(CONTROLS) + 2
    got = [cov.matrix[j * size + k, j * size + k] for j in range(2) for k in range(2)]
    np.testing.assert_allclose(got, expected, rtol=1e-8)
    assert cov.degrees == len(pdf) - x.shape[1]
    days = pd.DataFrame(load[:, :2] * residual[:, [0]]).groupby(pdf.day.to_numpy()).sum().to_numpy()
    g, n = len(days), len(pdf)
    cr1 = inference.day_cr1_covariance(df, model, gram)
    np.testing.assert_allclose(cr1.matrix[0, 0], (days[:, 0] ** 2).sum() * g / (g - 1) * (n - 1) / (n - x.shape[1]), rtol=1e-8)
    assert cr1.degrees == g - 1


def test_dml_scores_sum_to_zero_and_cover_theta_and_base(noisy):
    pdf, df = noisy
    gram, _, _ = estimate.collect_gram(df, CONTROLS)
    model = estimate.fit_dml(df, CONTROLS, "fold")
    cov = inference.dml_score_covariance(estimate.residualize(df, ["zone_id", "hr"], "fold"), model, gram)
    assert cov.degrees is None and cov.matrix.shape == (2 * (3 + len(CONTROLS)),) * 2
    np.testing.assert_allclose(cov.matrix, cov.matrix.T, atol=1e-12)
    assert np.linalg.eigvalsh(cov.matrix).min() > -1e-10


def test_bootstrap_draw_equals_a_refit_on_copied_days(noisy):
    pdf, df = noisy
    draws = resample.day_bootstrap(df, CONTROLS, 3).orderBy("draw_id").collect()
    times = resample.draw_multiplicities(df, 3).toPandas()
    for row in draws:
        copy = pdf.merge(times[times.draw_id == row["draw_id"]], on="day_id")
        w = copy.n_sessions * copy.times
        x = design(copy) * np.sqrt(w.to_numpy(float))[:, None]
        y = copy[["q_x", "q_y"]].to_numpy() * np.sqrt(w.to_numpy(float))[:, None]
        beta = np.linalg.lstsq(x, y, rcond=None)[0][:2].T.ravel()
        np.testing.assert_allclose([row[t] for t in resample.THETAS], beta, atol=1e-8)
        assert times[times.draw_id == row["draw_id"]].times.sum() == 14


def test_lost_price_variation_is_a_failed_draw(spark):
    pdf = frame(6)
    pdf.loc[pdf.day != 3, ["multiplier_y", "log_multiplier_y"]] = [1.0, 0.0]
    df = choice.encode(spark.createDataFrame(pdf), ZONES)
    draws = resample.day_bootstrap(df, CONTROLS, 40).collect()
    failed = [r for r in draws if r["status"] == "failed"]
    assert len(draws) == 40 and failed and all(r["theta_xx"] is None for r in failed)
    status = resample.bootstrap_status(spark.createDataFrame(draws), 40, minimum=10).first()
    assert status["interval_status"] == "interval_unstable"


def test_jackknife_leaves_out_one_day(noisy):
    pdf, df = noisy
    got = {r["day_id"]: r["theta_xy"] for r in resample.day_jackknife(df, CONTROLS).collect()}
    assert len(got) == 14
    for day in sorted(got)[:3]:
        rest = pdf[pdf.day_id != day]
        w = np.sqrt(rest.n_sessions.to_numpy(float))
        beta = np.linalg.lstsq(design(rest) * w[:, None], rest[["q_x"]].to_numpy() * w[:, None], rcond=None)[0]
        assert got[day] == pytest.approx(beta[1, 0], abs=1e-8)


def test_unit_leverage_is_refused(spark, noisy):
    pdf, _ = noisy
    lone = pd.concat([pdf[pdf.weekday != 3], pdf[pdf.weekday == 3].head(1)])
    df = choice.encode(spark.createDataFrame(lone), ZONES)
    gram, active, constants = estimate.collect_gram(df, CONTROLS)
    model = estimate.fit_from_gram(gram, "adjusted_ols", active, constants)
    with pytest.raises(Exception, match="leverage"):
        inference.hc3_covariance(df, model, gram)


def test_delta_intervals_withhold_small_baselines(spark, noisy):
    _, df = noisy
    gram, active, constants = estimate.collect_gram(df, CONTROLS)
    model = estimate.fit_from_gram(gram, "adjusted_ols", active, constants)
    controls, _ = inference.mean_controls(df, model)
    requests = spark.createDataFrame([("s", 1.0, 1.0, 1.1, 1.0, 100), ("t", 1.2, 0.9, 1.1, 1.0, 7)], "scenario_id string, multiplier_x0 double, multiplier_y0 double, multiplier_x1 double, multiplier_y1 double, n_sessions bigint")
    covariance = inference.hc3_covariance(df, model, gram)
    rows = inference.delta_intervals(requests, model, covariance, controls, floor=0.3).collect()
    # The same gradients over all coefficients, one request at a time.
    size = 2 + len(controls)
    for r in requests.collect():
        before, after = (np.r_[np.log([x, y]), controls] for x, y in ((r.multiplier_x0, r.multiplier_y0), (r.multiplier_x1, r.multiplier_y1)))
        gradient = np.r_[after - before, np.zeros(size)] * 100
        row = next(x for x in rows if (x.scenario_id, x.metric, x.outcome) == (r.scenario_id, "delta_percentage_points", "X"))
        assert row["standard_error"] == pytest.approx(np.sqrt(gradient @ covariance.matrix @ gradient))
    rows = [r for r in rows if r.scenario_id == "s"]
    by = {(r["metric"], r["outcome"]): r for r in rows}
    assert by[("elasticity", "Y/Y")]["point"] is None and by[("elasticity", "X/X")]["point"] < 0
    same = by[("delta_percentage_points", "X")]
    assert same["lower"] < same["point"] < same["upper"]
    total = sum(by[("before_probability", s)]["point"] for s in ("X", "Y", "NONE"))
    assert total == pytest.approx(1)


def test_truth_columns_are_refused(exact):
    _, df = exact
    with pytest.raises(ContractError):
        choice.observed_violations(df)


def test_sessions_and_blocks_are_inverse(spark, rows):
    blocks = spark.createDataFrame([("a", 3, 2, 25_001), ("b", 0, 1, 0)], "id string, n_x bigint, n_y bigint, n_none bigint")
    sessions = choice.blocks_to_sessions(blocks, ["id"])
    assert sessions.count() == 25_007 and sessions.select("session_id").distinct().count() == 25_007
    again = choice.sessions_to_blocks(sessions, ["id"])
    assert rows(again, "id", "n_x", "n_y", "n_none") == {("a", 3, 2, 25_001), ("b", 0, 1, 0)}


def test_folds_keep_days_whole_and_balanced(exact):
    _, df = exact
    folds = choice.day_folds(df, 4).collect()
    sizes = pd.DataFrame([r.asDict() for r in folds]).groupby("fold").n_blocks.sum()
    assert len(folds) == 14 and set(sizes.index) == {0, 1, 2, 3} and sizes.max() - sizes.min() <= 24


def test_unknown_estimators_are_refused(noisy):
    _, df = noisy
    with pytest.raises(ContractError, match="unknown estimator"):
        resample.day_bootstrap(df, CONTROLS, 3, estimator="ridge")


def test_keyed_fits_and_draws_equal_one_key_at_a_time(noisy):
    _, df = noisy
    keyed = df.withColumn("dataset", F.dayofmonth("day_id") % 2)
    fits = {r.dataset: r for r in resample.fit_by(keyed, CONTROLS, ["dataset"]).collect()}
    draws = resample.day_bootstrap(keyed, CONTROLS, 4, by=["dataset"]).collect()
    assert len(draws) == 8 and {r.status for r in draws} == {"succeeded"}
    for k in (0, 1):
        gram, active, constants = estimate.collect_gram(keyed.filter(F.col("dataset") == k), CONTROLS)
        model = estimate.fit_from_gram(gram, "adjusted_ols", active, constants)
        assert [fits[k][t] for t in resample.THETAS] == pytest.approx(model.theta.ravel().tolist())


def cross_fit_by_hand(copy):
    """Effects of a frame with a column `times`, from row residuals around the other folds' cell means."""
    copy = copy.assign(w=copy.n_sessions * copy.times)
    names = [*estimate.TREATMENTS, *estimate.OUTCOMES]
    parts = []
    for _, cell in copy.groupby(["zone_id", "hr"]):
        for fold, own in cell.groupby("fold"):
            rest = cell[cell.fold != fold]
            if rest.w.sum() > 0:
                means = (rest[names].mul(rest.w, axis=0)).sum() / rest.w.sum()
                parts.append(pd.concat([own[names] - means, own[["w"]]], axis=1))
    rows = pd.concat(parts)
    t, y = rows[names[:2]].to_numpy(), rows[names[2:]].to_numpy()
    w = rows.w.to_numpy(float)[:, None]
    return np.linalg.solve(t.T @ (w * t), t.T @ (w * y)).T.ravel()


def test_dml_draws_keep_a_days_fold_and_equal_refits_on_copies(noisy):
    pdf, df = noisy
    draws = resample.day_bootstrap(df, CONTROLS, 5, "dml").orderBy("draw_id").collect()
    times = resample.draw_multiplicities(df, 5).toPandas()
    assert [r.status for r in draws] == ["succeeded"] * 5
    for row in draws:
        copy = pdf.merge(times[times.draw_id == row.draw_id], on="day_id")
        np.testing.assert_allclose([row[t] for t in resample.THETAS], cross_fit_by_hand(copy), atol=1e-8)
    left = {r.day_id: r for r in resample.day_jackknife(df, CONTROLS, "dml").collect()}
    assert len(left) == 14
    for day in sorted(left)[:3]:
        copy = pdf[pdf.day_id != day].assign(times=1)
        np.testing.assert_allclose([left[day][t] for t in resample.THETAS], cross_fit_by_hand(copy), atol=1e-8)


def test_draw_blocks_and_keys_do_not_change_results(noisy, monkeypatch):
    _, df = noisy
    keyed = df.withColumn("dataset", F.dayofmonth("day_id") % 2)
    for estimator in ("adjusted_ols", "dml"):
        whole = {(r.dataset, r.draw_id): r for r in resample.day_bootstrap(keyed, CONTROLS, 7, estimator, by=["dataset"]).collect()}
        monkeypatch.setattr(draws, "DRAW_BLOCK", 3)
        parts = {(r.dataset, r.draw_id): r for r in resample.day_bootstrap(keyed, CONTROLS, 7, estimator, by=["dataset"]).collect()}
        monkeypatch.undo()
        assert len(whole) == 14 and whole.keys() == parts.keys()
        for key, row in whole.items():
            assert [parts[key][t] for t in resample.THETAS] == pytest.approx([row[t] for t in resample.THETAS])
            assert parts[key].coefficients == pytest.approx(row.coefficients)
    fits = {r.dataset: r for r in resample.fit_by(keyed, CONTROLS, ["dataset"], "dml").collect()}
    for k in (0, 1):
        one = estimate.fit_dml(keyed.filter(F.col("dataset") == k), CONTROLS, "fold")
        assert [fits[k][t] for t in resample.THETAS] == pytest.approx(one.theta.ravel().tolist())
        assert (fits[k]["rank"], fits[k].condition) == (one.rank, pytest.approx(one.condition))
        assert fits[k].intercept == pytest.approx(one.intercept.tolist())


def test_directions_that_are_not_identified_are_null(noisy):
    _, df = noisy
    line = df.withColumn("log_multiplier_y", 0.5 * F.col("log_multiplier_x"))
    fit = resample.fit_by(line.withColumn("dataset", F.lit(1)), CONTROLS, ["dataset"], "contrast_ols").first()
    assert fit.status == "succeeded" and fit["rank"] == 1 and [fit[t] for t in resample.THETAS] == [None] * 4
    flat = df.withColumn("log_multiplier_y", F.lit(0.1))
    fit = resample.fit_by(flat.withColumn("dataset", F.lit(1)), CONTROLS, ["dataset"], "contrast_ols", (0,)).first()
    assert fit.status == "succeeded" and fit.theta_xy is None and fit.theta_yy is None and fit.theta_xx is not None
    lost = resample.day_bootstrap(line, CONTROLS, 3, "contrast_ols").collect()
    assert {r.status for r in lost} == {"succeeded"} and all(r.theta_xx is None for r in lost)
    empty = resample.day_bootstrap(df.limit(0), CONTROLS, 3, "dml")
    assert empty.count() == 0 and resample.day_jackknife(df.limit(0), CONTROLS).count() == 0


def test_status_follows_the_stability_of_intervals(spark):
    rows = [(k, "succeeded", 0.1 * (k % 7), (0.0 if k < 20 else 5.0 * (k % 3))) for k in range(40)]
    table = spark.createDataFrame(rows, "draw_id int, status string, calm double, wild double")
    status = lambda *values: resample.bootstrap_status(table, 40, 30, values=values).first().interval_status
    assert (status(), status("calm"), status("calm", "wild")) == ("ok", "ok", "interval_unstable")
    keyed = table.withColumn("key", F.when(F.col("draw_id") % 2 == 0, "a"))
    found = {r.key: r.interval_status for r in resample.bootstrap_status(keyed, 20, 15, by=["key"], values=["calm"]).collect()}
    assert found == {"a": "ok", None: "ok"}
    some = table.withColumn("calm", F.when(F.col("draw_id") > 5, F.col("calm")))
    assert resample.bootstrap_status(some, 40, 30, values=["calm"]).first().interval_status == "interval_unstable"


def test_keyed_covariances_equal_one_key_at_a_time(noisy, monkeypatch):
    _, df = noisy
    table = df.withColumn("dataset", F.when(F.dayofmonth("day_id") % 2 == 0, "even"))
    parts = {"even": table.filter("dataset = 'even'"), None: table.filter("dataset is null")}
    for salts in (1, 16):
        monkeypatch.setattr(keyed, "SALTS", salts)
        for method in keyed.METHODS:
            found = {r.dataset: r for r in keyed.keyed_covariance(table, CONTROLS, ["dataset"], method).collect()}
            assert found.keys() == parts.keys()
            for key, part in parts.items():
                gram, active, constants = estimate.collect_gram(part, CONTROLS)
                if method == "score":
                    model = estimate.fit_dml(part, CONTROLS, "fold")
                    one = inference.dml_score_covariance(estimate.residualize(part, ["zone_id", "hr"], "fold"), model, gram)
                else:
                    model = estimate.fit_from_gram(gram, "adjusted_ols", active, constants)
                    one = (inference.hc3_covariance if method == "hc3" else inference.day_cr1_covariance)(part, model, gram)
                row = found[key]
                assert (row.status, row.degrees, row.method) == ("ok", one.degrees, one.method)
                np.testing.assert_allclose(row.covariance, one.matrix.ravel(), rtol=1e-6, atol=1e-12)
                size = len(one.matrix) // 2
                assert [row[e] ** 2 for e in keyed.ERRORS] == pytest.approx([one.matrix[i, i] for i in (0, 1, size, size + 1)])


def test_keys_that_cannot_be_fitted_fail_alone(noisy):
    _, df = noisy
    lone = df.filter("zone_id = 0").limit(3).withColumn("dataset", F.lit(1))
    flat = df.withColumn("log_multiplier_y", F.lit(0.1)).withColumn("dataset", F.lit(2))
    good = df.withColumn("dataset", F.lit(3))
    table = lone.unionByName(flat).unionByName(good)
    for method in keyed.METHODS:
        found = {r.dataset: r for r in keyed.keyed_covariance(table, CONTROLS, ["dataset"], method).collect()}
        assert found[3].status == "ok" and found[1].status == "failed" and found[1].reason and found[1].covariance is None
        assert found[2].status == "ok" and found[2].se_xx > 0 and found[2].se_xy is None
    contrast = keyed.keyed_covariance(good.withColumn("log_multiplier_y", 0.5 * F.col("log_multiplier_x")), CONTROLS, ["dataset"], "day_cr1", "contrast_ols")
    assert contrast.first().status == "ok"
    assert keyed.keyed_covariance(good.limit(0), CONTROLS, ["dataset"]).count() == 0
    with pytest.raises(ContractError, match="unknown covariance"):
        keyed.keyed_covariance(good, CONTROLS, ["dataset"], "hc9")
