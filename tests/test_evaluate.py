import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from farewise.operators import evaluate, mnl, policy
from farewise.sources.tables import ContractError


@pytest.fixture(scope="module")
def metrics(spark):
    rows = [("A", "e", s, 0.1 * s, 0.2, 0.1 * s - 0.15, 0.1 * s + 0.15) for s in range(4)] + [("A", "e", 4, None, 0.2, None, None)]
    df = spark.createDataFrame(rows, "dgp_id string, estimator string, seed int, theta double, true_theta double, theta_lower double, theta_upper double")
    return evaluate.method_metrics(df)


def test_failed_fits_stay_in_the_denominators(metrics):
    row = evaluate.aggregate_metrics(metrics, 5).first()
    assert (row["attempted_seeds"], row["valid_estimates"], row["failed_estimates"]) == (5, 4, 1)
    assert row["bias"] == pytest.approx(-0.05) and row["coverage"] == pytest.approx(0.75)
    assert row["false_positive_rate"] is None and row["false_positive_lower"] is None
    assert row["interval_quality"] == "development_or_unstable"


def test_unmatched_cohorts_have_no_ratio(metrics):
    df = metrics.withColumn("standard_error", F.when(F.col("seed") != 2, 0.1))
    row = evaluate.sd_ratio(df).first()
    assert row["comparison_status"] == "unmatched_seed_cohorts" and row["sd_ratio"] is None


def test_null_truth_gives_false_positives(spark):
    rows = [("N", "e", 0, 0.3, 0.0, 0.1, 0.5), ("N", "e", 1, 0.1, 0.0, -0.1, 0.3)]
    df = spark.createDataFrame(rows, "dgp_id string, estimator string, seed int, theta double, true_theta double, theta_lower double, theta_upper double")
    assert [r["false_positive"] for r in evaluate.method_metrics(df).orderBy("seed").collect()] == [True, False]


def trajectories(spark, rows):
    return spark.createDataFrame(rows, "policy_id string, seed int, status string, value double")


def test_pairs_need_both_runs(spark):
    rows = [("base", s, "succeeded", 10.0 + s) for s in range(4)] + [("new", s, "failed" if s == 1 else "succeeded", 12.0 + 2 * s) for s in range(3)]
    row = policy.paired_summary(policy.paired_differences(trajectories(spark, rows), "base", ["value"]), 4).first()
    assert (row["available_pairs"], row["unavailable_pairs"], row["status"]) == (2, 2, "partial")
    assert row["delta_mean"] == pytest.approx(3.0) and row["delta_lower"] < 3 < row["delta_upper"]
    strict = policy.paired_summary(policy.paired_differences(trajectories(spark, rows), "base", ["value"]), 4, complete_only=True).first()
    assert strict["delta_lower"] is None and strict["delta_mean"] == pytest.approx(3.0)


def summary(spark, rows):
    fields = "sensitivity_id string, policy_id string, metric string, available_pairs int, unavailable_pairs int, target_mean double, delta_lower double, delta_upper double, model_delta_lower double, model_delta_upper double, interval_status string"
    return spark.createDataFrame(rows, fields)


def test_decisions_need_gain_robustness_and_guardrails(spark):
    rows = []
    for name, score, gain, slow, guard, interval in (
        ("good", 5.0, 1.0, 0.8, 10.0, "available"), ("better", 7.0, 1.0, 0.8, 99.0, "available"),
        ("fragile", 6.0, 1.0, -1.0, 10.0, "available"), ("unsure", 8.0, None, 1.0, 10.0, "unavailable"),
    ):
        for s in ("declared_rules", "slow"):
            rows.append((s, name, "pay", 4, 0, score, slow, 9.0, gain if s == "declared_rules" else None, 9.0, interval))
            rows.append((s, name, "wait", 4, 0, guard, 0.0, 0.0, None, None, "available"))
    guards = spark.createDataFrame([("wait", "maximum", 20.0)], "metric string, direction string, limit double")
    got = {r["policy_id"]: r for r in policy.decide(summary(spark, rows), guards, "pay", 0.5).collect()}
    assert got["good"]["selected"] and got["good"]["reasons"] == []
    assert len(got["better"]["reasons"]) == 2 and got["better"]["status"] == "not_recommended"
    assert got["fragile"]["reasons"] == ["objective not robust under slow"]
    assert len(got["unsure"]["reasons"]) == 2 and not got["unsure"]["selected"]
    regret = policy.frozen_regret(summary(spark, rows).filter("sensitivity_id = 'declared_rules'"), guards, "pay", "good").first()
    assert regret["best_policy_id"] == "unsure" and regret["regret"] == pytest.approx(3.0)
    lost = policy.frozen_regret(summary(spark, rows).filter("sensitivity_id = 'declared_rules'"), guards, "pay", "better").first()
    assert lost["regret"] is None and lost["chosen_feasible"] is False


def test_model_draws_must_all_be_complete(spark):
    rows = [(d, p, s, "failed" if (d, s, p) == (3, 1, "new") else "succeeded", d * 1.0 + (p == "new")) for d in range(20) for p in ("base", "new") for s in range(2)]
    df = spark.createDataFrame(rows, "draw_id int, policy_id string, seed int, status string, value double")
    row = policy.model_draw_intervals(df, "base", ["value"], 20, 2).first()
    assert row["valid_model_draws"] == 19 and row["interval_status"] == "unavailable" and row["model_delta_lower"] is None
    whole = policy.model_draw_intervals(df.withColumn("status", F.lit("succeeded")), "base", ["value"], 20, 2).first()
    assert whole["interval_status"] == "available" and whole["model_delta_lower"] == pytest.approx(1.0)


def choices(n=4000, seed=2):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({f"{k}{j}": rng.uniform(10, 200, n) for k in ("tt", "co") for j in range(3)})
    pdf["av0"], pdf["av1"], pdf["av2"] = True, True, rng.random(n) < 0.7
    pdf["person_id"] = rng.integers(0, 300, n)
    beta = np.array([0.4, -0.3, -1.2, -0.7])
    u = np.column_stack([beta[2] * pdf[f"tt{j}"] / 100 + beta[3] * pdf[f"co{j}"] / 100 for j in range(3)]) + np.array([beta[0], 0, beta[1]])
    u[~pdf.av2, 2] = -np.inf
    pdf["choice_index"] = (u + rng.gumbel(size=u.shape)).argmax(1)
    return pdf


def reference_fit(pdf):
    """Newton iterations on the whole sample in memory."""
    x = np.zeros((len(pdf), 3, 4))
    x[:, 0, 0], x[:, 2, 1] = 1, 1
    for j in range(3):
        x[:, j, 2], x[:, j, 3] = pdf[f"tt{j}"] / 100, pdf[f"co{j}"] / 100
    open_ = pdf[["av0", "av1", "av2"]].to_numpy(bool)
    beta = np.zeros(4)
    for _ in range(30):
        u = np.where(open_, x @ beta, -np.inf)
        p = np.exp(u - u.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        mean = np.einsum("na,nak->nk", p, x)
        g = (x[np.arange(len(pdf)), pdf.choice_index] - mean).sum(0)
        h = np.einsum("na,nak,nal->kl", p, x, x) - mean.T @ mean
        beta = beta + np.linalg.solve(h, g)
    return beta


def test_choice_fit_equals_an_in_memory_fit(spark):
    pdf = choices()
    fit = mnl.fit_mnl(mnl.choice_features(spark.createDataFrame(pdf)))
    np.testing.assert_allclose(fit["beta"], reference_fit(pdf), atol=1e-5)
    assert np.abs(fit["gradient"]).max() < 1e-7
    score = mnl.score_mnl(mnl.choice_features(spark.createDataFrame(pdf)), fit["beta"]).first()
    assert score["log_loss"] == pytest.approx(-fit["log_likelihood"] / len(pdf)) and score["n_people"] == pdf.person_id.nunique()


def test_constant_attributes_are_not_identified(spark):
    pdf = choices(500)
    for j in range(3):
        pdf[f"tt{j}"] = 50.0
    with pytest.raises(ContractError, match="rank"):
        mnl.fit_mnl(mnl.choice_features(spark.createDataFrame(pdf)))


def test_people_are_split_exactly_and_never_shared(spark):
    df = spark.createDataFrame(choices())
    split = mnl.split_people(df, 5).select("person_id", "split").distinct()
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(sizes.values()) == df.select("person_id").distinct().count() == 300
    assert sizes == {"train": 210, "validation": 45, "test": 45}


def test_unavailable_alternatives_never_get_probability(spark):
    out = mnl.log_probabilities(mnl.choice_features(spark.createDataFrame(choices(200))), [0.1, 0.2, -1.0, -1.0])
    assert out.filter("not av2 and lp2 is not null").count() == 0
    mass = F.exp("lp0") + F.exp("lp1") + F.coalesce(F.exp("lp2"), F.lit(0.0))
    assert out.filter(F.abs(mass - 1) > 1e-12).count() == 0
