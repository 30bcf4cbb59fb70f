"""Multinomial logit on stated choices, fitted by distributed Newton steps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewise.functions.scalars import all_of, any_of, hash_uniform, is_finite, total
from farewise.functions.skew import Quantile, exact_quantiles
from farewise.operators.quality import check_contract
from farewise.sources.tables import ContractError

ALTERNATIVES = 3
# Parameters: constants of alternatives 0 and 2 against 1, then time and cost.
PARAMETERS = ("asc_0", "asc_2", "time", "cost")


def choice_rules() -> dict[str, Column]:
    """Bad-row conditions of a stated-choice table tt<j>, co<j>, av<j>, choice_index."""
    numeric = [f"{p}{j}" for p in ("tt", "co") for j in range(ALTERNATIVES)]
    chosen_off = any_of([(F.col("choice_index") == j) & ~F.col(f"av{j}") for j in range(ALTERNATIVES)])
    return {
        "nonfinite_attribute": any_of([~is_finite(c) for c in numeric]),
        "negative_attribute": any_of([F.col(c) < 0 for c in numeric]),
        "unknown_choice": ~F.coalesce(F.col("choice_index").between(0, ALTERNATIVES - 1), F.lit(False)),
        "chosen_unavailable": chosen_off,
        "nothing_available": all_of([~F.col(f"av{j}") for j in range(ALTERNATIVES)]),
    }


def prepare_choices(raw: DataFrame) -> DataFrame:
    """Rows with a known available choice and valid attributes; duplicates stay."""
    bad = any_of([F.coalesce(c, F.lit(True)) for c in choice_rules().values()])
    return raw.filter(~bad)


def choice_quality(raw: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Violations per rule and the number of repeated tasks."""
    rules = check_contract(raw, choice_rules())
    repeated = raw.groupBy(*identity).count().filter("count > 1")
    extra = repeated.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
    return rules.unionByName(extra.select(F.lit("repeated_task").alias("rule"), "violations"))


def split_people(
    df: DataFrame, seed: int, person: str = "person_id", train: float = 0.7, validation: float = 0.15
) -> DataFrame:
    """Label rows train, validation or test by person, with exact shares of people.

    People are ordered by a keyed draw; the two cut points are order statistics over distinct
    people, so rows are labelled by comparing their own draw and are never shuffled.
    """
    draw = hash_uniform(F.lit(seed), person)
    people = df.select(person).distinct().select(draw.alias("u"))
    n = people.count()
    if n < 7:
        raise ContractError("a person-level split needs at least seven people")
    ranks = [int(n * train), int(n * (train + validation) + 1e-9)]
    wanted = [Quantile(f"cut{i}", "u", r / (n - 1)) for i, r in enumerate(ranks)]
    cuts = exact_quantiles(people, [], wanted).first()
    # Half a hash step below the cut keeps the comparison safe from interpolation noise.
    first, second = (F.lit(float(c) - 2.0**-34) for c in cuts)
    return df.withColumn("split", F.when(draw < first, "train").when(draw < second, "validation").otherwise("test"))


def choice_features(df: DataFrame, pass_holder: str | None = None, scale: float = 100.0) -> DataFrame:
    """Scaled attributes t<j>, c<j>; a pass holder pays nothing for alternatives 0 and 1."""
    free = F.col(pass_holder) if pass_holder else F.lit(False)
    out = {}
    for j in range(ALTERNATIVES):
        out[f"t{j}"] = F.col(f"tt{j}") / scale
        cost = F.col(f"co{j}") / scale
        out[f"c{j}"] = F.when(free, 0.0).otherwise(cost) if j < 2 and pass_holder else cost
    return df.withColumns(out)


def _design(j: int) -> list[Column]:
    return [F.lit(1.0 if j == 0 else 0.0), F.lit(1.0 if j == 2 else 0.0), F.col(f"t{j}"), F.col(f"c{j}")]


def utilities(beta: Sequence[float | Column]) -> list[Column]:
    """Utility per alternative, NULL where it is not available; parameters are numbers or columns."""
    weights = [b if isinstance(b, Column) else F.lit(float(b)) for b in beta]
    return [F.when(F.col(f"av{j}"), total([b * x for b, x in zip(weights, _design(j))])) for j in range(ALTERNATIVES)]


def log_probabilities(df: DataFrame, beta: Sequence[float | Column]) -> DataFrame:
    """Availability-masked log-softmax lp<j>; the largest utility is taken out first."""
    with_u = df.withColumns({f"u{j}": u for j, u in enumerate(utilities(beta))})
    top = F.greatest(*[F.col(f"u{j}") for j in range(ALTERNATIVES)])
    mass = total([F.coalesce(F.exp(F.col(f"u{j}") - top), F.lit(0.0)) for j in range(ALTERNATIVES)])
    denominator = top + F.ln(mass)
    out = with_u.withColumn("_d", denominator)
    return out.withColumns({f"lp{j}": F.col(f"u{j}") - F.col("_d") for j in range(ALTERNATIVES)}).drop("_d", *[f"u{j}" for j in range(ALTERNATIVES)])


def _chosen() -> Column:
    out = F.lit(None).cast("double")
    for j in range(ALTERNATIVES):
        out = F.when(F.col("choice_index") == j, F.col(f"lp{j}")).otherwise(out)
    return out


def newton_terms(df: DataFrame, beta: Sequence[float | Column], *keep: str) -> DataFrame:
    """Per row, what `newton_columns` sums up, beside the columns to keep."""
    k = len(beta)
    scored = log_probabilities(df, beta)
    p = [F.coalesce(F.exp(F.col(f"lp{j}")), F.lit(0.0)) for j in range(ALTERNATIVES)]
    x = [_design(j)[:k] for j in range(ALTERNATIVES)]
    return scored.select(
        *keep, _chosen().alias("ll"),
        *[total([p[j] * x[j][a] for j in range(ALTERNATIVES)]).alias(f"e{a}") for a in range(k)],
        *[total([F.when(F.col("choice_index") == j, x[j][a]).otherwise(0.0) for j in range(ALTERNATIVES)]).alias(f"o{a}") for a in range(k)],
        *[total([p[j] * x[j][a] * x[j][b] for j in range(ALTERNATIVES)]).alias(f"q{a}{b}") for a in range(k) for b in range(a, k)],
    )


def newton_columns(k: int) -> list[Column]:
    """Log-likelihood, gradient and upper triangle of the information as sums."""
    sums = [F.sum("ll")] + [F.sum(F.col(f"o{a}") - F.col(f"e{a}")) for a in range(k)]
    sums += [F.sum(F.col(f"q{a}{b}") - F.col(f"e{a}") * F.col(f"e{b}")) for a in range(k) for b in range(a, k)]
    return sums


def _newton_sums(df: DataFrame, beta: Sequence[float]) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and information at beta from one aggregate of 15 sums."""
    k = len(beta)
    row = newton_terms(df, beta).agg(*newton_columns(k)).first()
    gradient = np.array(row[1 : 1 + k], float)
    information = np.zeros((k, k))
    information[np.triu_indices(k)] = row[1 + k :]
    information = information + np.triu(information, 1).T
    return float(row[0]), gradient, information


def fit_mnl(df: DataFrame, attributes: bool = True, tolerance: float = 1e-7, max_steps: int = 50) -> dict:
    """Maximum likelihood: one aggregate per Newton step over the persisted features.

    The likelihood is concave, so a step is halved until it improves. A singular information
    matrix or a search that does not converge is an error, never an answer.
    """
    columns = ["choice_index", *[f"{p}{j}" for j in range(ALTERNATIVES) for p in ("t", "c", "av")]]
    data = df.select(*columns).persist()
    try:
        counts = data.agg(F.count(F.lit(1)), F.count_distinct("choice_index")).first()
        n = counts[0]
        if counts[1] != ALTERNATIVES:
            raise ContractError("training needs observed choices of every alternative")
        beta = np.zeros(len(PARAMETERS) if attributes else 2)
        value, gradient, information = _newton_sums(data, beta)
        for step in range(max_steps):
            if np.linalg.matrix_rank(information / n, tol=1e-10) < len(beta):
                raise ContractError("choice information matrix lacks rank")
            if np.abs(gradient).max() / n < tolerance:
                break
            move = np.linalg.solve(information, gradient)
            for _ in range(30):
                candidate = _newton_sums(data, beta + move)
                if candidate[0] >= value - 1e-9 * abs(value):
                    break
                move = move / 2
            else:
                raise ContractError("no improving step was found")
            beta = beta + move
            value, gradient, information = candidate
        else:
            raise ContractError("choice model did not converge")
    finally:
        data.unpersist()
    return {
        "beta": beta, "log_likelihood": value, "gradient": gradient / n, "information": information, "n": n, "steps": step,
        "standard_errors": np.sqrt(np.diag(np.linalg.inv(information))),
    }


def score_mnl(df: DataFrame, beta: Sequence[float], by: Sequence[str] = (), person: str = "person_id") -> DataFrame:
    """Log loss, mean of person means, accuracy and counts; two-level aggregate by person."""
    scored = log_probabilities(df, beta)
    best = F.lit(0)
    top = F.coalesce("lp0", F.lit(float("-inf")))
    for j in range(1, ALTERNATIVES):
        value = F.coalesce(f"lp{j}", F.lit(float("-inf")))
        best, top = F.when(value > top, j).otherwise(best), F.greatest(value, top)
    rows = scored.select(*by, person, (-_chosen()).alias("loss"), (best == F.col("choice_index")).cast("double").alias("hit"))
    people = rows.groupBy(*by, person).agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss"), F.sum("hit").alias("hits"))
    return people.groupBy(*by).agg(
        F.sum("n").alias("n_tasks"), F.count(F.lit(1)).alias("n_people"),
        (F.sum("loss") / F.sum("n")).alias("log_loss"), F.avg(F.col("loss") / F.col("n")).alias("person_mean_loss"),
        (F.sum("hits") / F.sum("n")).alias("accuracy"),
    )
