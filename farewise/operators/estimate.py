"""Price-response estimation from mergeable second moments.

One pass over the blocks gives weighted cross products; every estimator is then algebra on
a k x k matrix (k about 20). Grouped passes (`by` = day, fold, dataset) serve resampling.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from farewise.functions.scalars import any_of, is_finite, safe_div, total, weighted_mean
from farewise.functions.skew import null_safe_join
from farewise.operators.quality import check_contract
from farewise.session import scratch_path
from farewise.sources.tables import ContractError

OUTCOMES = ("q_x", "q_y")
TREATMENTS = ("log_multiplier_x", "log_multiplier_y")
WEIGHT = "n_sessions"

# Tolerances of the identification rules.
RANK_TOLERANCE = 1e-10
SPAN_TOLERANCE = 1e-8

FLUSH_GROUPS = 2048


# --- mergeable sums -----------------------------------------------------------------------

def grouped_sums(
    df: DataFrame,
    columns: Sequence[str],
    contribution: Callable[[np.ndarray], np.ndarray],
    by: Sequence[str] = (),
) -> DataFrame:
    """Sum of per-row-block vectors: (by..., g array<double>).

    `contribution` maps an (n, len(columns)) array to the vector that n rows add to the sum.
    Each task reduces its Arrow batches to a few vectors per group before the shuffle, and the
    shuffle sums element by element, so a group of any size costs one short vector per task.
    """
    by = list(by)
    cast = [F.col(c).cast("double").alias(c) for c in columns]
    source = df.select(*by, *cast)
    names = list(columns)
    schema = ", ".join([*[f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by], "g array<double>"])

    def reduce_batches(batches):
        held: dict[tuple, np.ndarray] = {}

        def rows():
            out = pd.DataFrame(list(held), columns=by) if by else pd.DataFrame(index=range(len(held)))
            out["g"] = [v.tolist() for v in held.values()]
            held.clear()
            return out

        for batch in batches:
            values = batch[names].to_numpy(float)
            if by:
                groups = batch.groupby(by, sort=False, dropna=False).indices.items()
            else:
                groups = [((), np.arange(len(batch)))]
            for key, index in groups:
                key = key if isinstance(key, tuple) else (key,)
                if len(index):
                    vector = contribution(values[index])
                    held[key] = held[key] + vector if key in held else vector
            if len(held) >= FLUSH_GROUPS:
                yield rows()
        if held:
            yield rows()

    return added(source.mapInPandas(reduce_batches, schema), by)


def added(partial: DataFrame, by: Sequence[str]) -> DataFrame:
    """Vectors `g` summed element by element per key."""
    parts = partial.select(*by, F.posexplode("g").alias("i", "v"))
    summed = parts.groupBy(*by, "i").agg(F.sum("v").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))
    return summed.groupBy(*by).agg(F.transform(ordered, lambda s: s["v"]).alias("g"))


def design_columns(controls: Sequence[str]) -> list[str]:
    return [*TREATMENTS, *controls, *OUTCOMES, WEIGHT]


def _cross_products(values: np.ndarray) -> np.ndarray:
    """Rows and flattened w z z' for z = (1, t, controls, y); the last input is the weight."""
    z = np.column_stack([np.ones(len(values)), values[:, :-1]])
    return np.r_[float(len(values)), (z.T @ (z * values[:, -1:])).ravel()]


def weighted_gram(df: DataFrame, controls: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., g): row count followed by the flattened weighted cross-product matrix."""
    return grouped_sums(df, design_columns(controls), _cross_products, by)


def moments(
    df: DataFrame, by: Sequence[str], columns: Sequence[str] = (*TREATMENTS, *OUTCOMES), weight: str = WEIGHT
) -> DataFrame:
    """First and second weighted moments of a few columns per group, fully native.

    Columns: n, w, s_<i> = sum(w c_i), m_<i><j> = sum(w c_i c_j) for i <= j.
    """
    w = F.col(weight).cast("double")
    c = [F.col(x).cast("double") for x in columns]
    sums = [F.count(F.lit(1)).alias("n"), F.sum(w).alias("w")]
    sums += [F.sum(w * x).alias(f"s_{i}") for i, x in enumerate(c)]
    sums += [F.sum(w * c[i] * c[j]).alias(f"m_{i}{j}") for i in range(len(c)) for j in range(i, len(c))]
    return df.groupBy(*by).agg(*sums)


def solve_two(a: Column, b: Column, d: Column, c: Column, e: Column) -> tuple[Column, Column]:
    """Solution of [[a, b], [b, d]] x = [c, e]; NULL when the system has no full rank."""
    det = a * d - b * b
    usable = F.abs(det) > RANK_TOLERANCE * F.greatest(a * d, F.lit(1e-300))
    return (
        F.when(usable, safe_div(d * c - b * e, det)),
        F.when(usable, safe_div(a * e - b * c, det)),
    )


def theta_columns(m: Callable[[int, int], Column]) -> list[Column]:
    """The four effects from centred cross products m(i, j) of (t_x, t_y, y_x, y_y)."""
    out = []
    for j, y in enumerate("xy"):
        first, second = solve_two(m(0, 0), m(0, 1), m(1, 1), m(0, 2 + j), m(1, 2 + j))
        out += [first.alias(f"theta_{y}x"), second.alias(f"theta_{y}y")]
    return out


def _pair(i: int, j: int) -> str:
    return f"m_{min(i, j)}{max(i, j)}"


def theta_from_moments(sums: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Intercept-and-prices regression solved from one row of moments per group."""

    def centred(i: int, j: int) -> Column:
        return F.col(_pair(i, j)) - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("w")

    return sums.select(*keep, *theta_columns(centred))


def within_cell_moments(df: DataFrame, cell: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Cross products around weighted cell means, one row per `by` group.

    Sum over cells of (m_ij - s_i s_j / w): no residual rows and a single aggregation chain.
    """
    per_cell = moments(df, [*by, *cell])
    terms = [
        F.sum(F.col(_pair(i, j)) - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("w")).alias(_pair(i, j))
        for i in range(4)
        for j in range(i, 4)
    ]
    return per_cell.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("w").alias("w"), *terms)


def fit_within_cells(df: DataFrame, cell: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adjusted least squares with a full set of cell effects as controls."""
    sums = within_cell_moments(df, cell, by)
    return sums.select(*by, *theta_columns(lambda i, j: F.col(_pair(i, j))))


def cell_mean_moments(
    df: DataFrame, cell: Sequence[str], fold: str, by: Sequence[str] = ()
) -> DataFrame:
    """Cross products of out-of-fold residuals, where the nuisance is the cell mean elsewhere.

    Inside one (cell, fold) the prediction is constant, so residual products follow from that
    group's moments; cells seen in a single fold have no prediction and contribute nothing.
    """
    per = moments(df, [*by, *cell, fold])
    rest = Window.partitionBy(*by, *cell)
    other_w = F.sum("w").over(rest) - F.col("w")
    means = {f"p_{i}": safe_div(F.sum(f"s_{i}").over(rest) - F.col(f"s_{i}"), other_w) for i in range(4)}
    placed = per.withColumns(means).filter(F.col("p_0").isNotNull())

    def product(i: int, j: int) -> Column:
        return (
            F.col(_pair(i, j)) - F.col(f"p_{j}") * F.col(f"s_{i}") - F.col(f"p_{i}") * F.col(f"s_{j}")
            + F.col(f"p_{i}") * F.col(f"p_{j}") * F.col("w")
        )

    terms = [F.sum(product(i, j)).alias(_pair(i, j)) for i in range(4) for j in range(i, 4)]
    return placed.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("w").alias("w"), *terms)


def fit_dml_cell_means(df: DataFrame, cell: Sequence[str], fold: str, by: Sequence[str] = ()) -> DataFrame:
    """Cross-fitted orthogonal regression with cell-mean nuisances, solved per `by` group."""
    sums = cell_mean_moments(df, cell, fold, by)
    return sums.select(*by, *theta_columns(lambda i, j: F.col(_pair(i, j))))


def residualize(df: DataFrame, cell: Sequence[str], fold: str | None = None) -> DataFrame:
    """Row residuals r_tx, r_ty, r_yx, r_yy around cell means (of the other folds if given)."""
    keys = [*cell, *([fold] if fold else [])]
    names = [*TREATMENTS, *OUTCOMES]
    w = F.col(WEIGHT).cast("double")
    sums = df.groupBy(*keys).agg(
        F.sum(w).alias("_w"), *[F.sum(w * F.col(c)).alias(f"_s{i}") for i, c in enumerate(names)]
    )
    if fold:
        rest = Window.partitionBy(*cell)
        minus = {c: F.sum(c).over(rest) - F.col(c) for c in ["_w", *[f"_s{i}" for i in range(4)]]}
        sums = sums.select(*keys, *[e.alias(c) for c, e in minus.items()])
    joined = null_safe_join(df, sums, keys, "inner")
    out = {
        r: F.col(c) - safe_div(f"_s{i}", "_w") for i, (r, c) in enumerate(zip(("r_tx", "r_ty", "r_yx", "r_yy"), names))
    }
    return joined.withColumns(out).drop("_w", "_s0", "_s1", "_s2", "_s3")


REGRESSIONS = ("naive_ols", "adjusted_ols", "contrast_ols")


# --- models -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    """A fitted price response; every array here has at most a few dozen entries."""

    estimator: str
    status: str
    controls: tuple[str, ...]
    n: int = 0
    weight: float = 0.0
    active: tuple[int, ...] = (0, 1)
    constants: tuple[float | None, float | None] = (None, None)
    theta: np.ndarray = field(default_factory=lambda: np.full((2, 2), np.nan))
    intercept: np.ndarray = field(default_factory=lambda: np.full(2, np.nan))
    coefficients: np.ndarray = field(default_factory=lambda: np.empty((2, 0)))
    basis: np.ndarray | None = None
    anchor: np.ndarray | None = None
    rank: int = 0
    condition: float | None = None
    warnings: tuple[str, ...] = ()

    @property
    def ok(self) -> bool:
        return self.status == "ok"

    def baseline(self, outcome: int) -> Column:
        """Share at zero log prices for a row of encoded controls."""
        terms = [F.lit(float(self.intercept[outcome]))]
        terms += [F.lit(float(b)) * F.col(c).cast("double") for b, c in zip(self.coefficients[outcome], self.controls)]
        return total(terms)

    def effect(self, outcome: int, log_x: Column, log_y: Column) -> Column:
        prices = (log_x, log_y)
        return total([F.lit(float(self.theta[outcome, k])) * prices[k] for k in self.active] or [F.lit(0.0)])

    def rows(self, spark: SparkSession) -> DataFrame:
        """The model as a table (estimator, outcome, term, value)."""
        out = []
        for j, outcome in enumerate("XY"):
            out += [(self.estimator, outcome, f"theta_{'XY'[k].lower()}", float(self.theta[j, k])) for k in self.active]
            out += [(self.estimator, outcome, "intercept", float(self.intercept[j]))]
            out += [(self.estimator, outcome, c, float(v)) for c, v in zip(self.controls, self.coefficients[j])]
        return spark.createDataFrame(out, "estimator string, outcome string, term string, value double")


class Gram:
    """Weighted cross products with named blocks, as a plain matrix on the driver."""

    def __init__(self, values: Sequence[float], controls: Sequence[str]):
        self.controls = tuple(controls)
        size = 1 + 2 + len(self.controls) + 2
        values = np.asarray(values, float)
        self.n = int(round(values[0]))
        self.matrix = values[1:].reshape(size, size)

    @property
    def weight(self) -> float:
        return float(self.matrix[0, 0])

    def index(self, *names: str) -> list[int]:
        order = ["1", "t0", "t1", *self.controls, "y0", "y1"]
        return [order.index(n) for n in names]

    def regress(self, targets: list[int], on: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Intercepts and minimum-norm slopes of a weighted regression with intercept."""
        w = self.weight
        mean = self.matrix[0] / w
        centred = self.matrix - np.outer(mean, mean) * w
        xx, xy = centred[np.ix_(on, on)], centred[np.ix_(on, targets)]
        slopes = (pseudo_inverse(xx) @ xy).T if on else np.zeros((len(targets), 0))
        return mean[targets] - slopes @ mean[on], slopes

    def residual_covariance(self, active: Sequence[int], on: list[int]) -> np.ndarray:
        """Covariance of active log prices after regression on `on`."""
        t = self.index(*[f"t{k}" for k in active])
        w, mean = self.weight, self.matrix[0] / self.weight
        centred = self.matrix - np.outer(mean, mean) * w
        tt, tz = centred[np.ix_(t, t)], centred[np.ix_(t, on)]
        return (tt - tz @ pseudo_inverse(centred[np.ix_(on, on)]) @ tz.T if on else tt) / w

    def varying(self) -> tuple[int, ...]:
        """Treatments with any variation, judged on the standard deviation."""
        w, mean = self.weight, self.matrix[0] / self.weight
        variance = [self.matrix[i, i] / w - mean[i] ** 2 for i in self.index("t0", "t1")]
        return tuple(k for k in range(2) if variance[k] > 1e-12)


def pseudo_inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse on the range of a symmetric matrix, after scaling to unit diagonal."""
    scale = np.sqrt(np.maximum(np.diag(matrix), 0))
    scale = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(matrix / np.outer(scale, scale))
    keep = values > 1e-11 * max(values.max(initial=0.0), 1e-300)
    if keep.all():
        return np.linalg.inv(matrix)
    # Minimum norm in the original units: invert on the range of the unscaled matrix.
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][: int(keep.sum())]
    return (vectors[:, order] / values[order]) @ vectors[:, order].T


def identification(gram: Gram, active: Sequence[int], controls: Sequence[str]) -> tuple[int, float | None]:
    """Rank and condition number of the residual price covariance."""
    covariance = gram.residual_covariance(active, gram.index(*controls))
    values = np.linalg.eigvalsh(covariance)
    rank = int((values > RANK_TOLERANCE).sum())
    smallest = values.min()
    return rank, float(values.max() / smallest) if smallest > 0 else None


def contrast_basis(covariance: np.ndarray) -> tuple[np.ndarray, float | None]:
    """Directions of residual price variation that are kept; identity when all are."""
    values, vectors = np.linalg.eigh(covariance)
    kept = values > RANK_TOLERANCE
    if kept.all():
        basis = np.eye(len(values))
    else:
        basis = vectors[:, kept][:, ::-1]
    condition = float(values[kept].max() / values[kept].min()) if kept.any() else None
    return basis, condition


def fit_from_gram(
    gram: Gram,
    estimator: str,
    active: tuple[int, ...] | None = None,
    constants: tuple[float | None, float | None] = (None, None),
    max_condition: float = 1000.0,
    theta: np.ndarray | None = None,
) -> Model:
    """Fit naive_ols, adjusted_ols or contrast_ols; with `theta` given, only the base rate.

    Rank problems are reported in `status`, never answered by a pseudo-inverse theta.
    """
    if theta is None:
        check_estimator(estimator)
    active = gram.varying() if active is None else active
    model = Model(estimator, "ok", gram.controls, gram.n, gram.weight, active, constants)
    if not active:
        return replace(model, status="not_identified", warnings=("neither price varies",))
    z = gram.index(*gram.controls)
    t, y = gram.index(*[f"t{k}" for k in active]), gram.index("y0", "y1")
    rank, condition = identification(gram, active, gram.controls)
    basis = anchor = None
    if estimator == "contrast_ols":
        basis, condition = contrast_basis(gram.residual_covariance(active, z))
        rank = basis.shape[1]
        intercept_t, slopes_t = gram.regress(t, z)
        anchor = np.column_stack([intercept_t, slopes_t])
    model = replace(model, rank=rank, condition=condition, basis=basis, anchor=anchor)
    if rank == 0 or (rank < len(active) and estimator != "contrast_ols"):
        return replace(model, status="not_identified", warnings=("residual price covariance lacks rank",))
    if condition is None or condition > max_condition:
        model = replace(model, warnings=("residual price covariance is poorly conditioned",))
    full = np.zeros((2, 2))
    if theta is not None:
        full[:, list(active)] = np.asarray(theta)[:, list(active)]
    elif estimator == "naive_ols":
        full[:, list(active)] = gram.regress(y, t)[1]
    elif basis is None:
        full[:, list(active)] = gram.regress(y, t + z)[1][:, : len(active)]
    else:
        # Partial out the controls, then regress in the retained price directions.
        mean, w = gram.matrix[0] / gram.weight, gram.weight
        centred = gram.matrix - np.outer(mean, mean) * w
        inverse = pseudo_inverse(centred[np.ix_(z, z)])
        project = lambda a, b: centred[np.ix_(a, b)] - centred[np.ix_(a, z)] @ inverse @ centred[np.ix_(z, b)]
        tt, ty = basis.T @ project(t, t) @ basis, basis.T @ project(t, y)
        full[:, list(active)] = (basis @ np.linalg.solve(tt, ty)).T
    if not np.isfinite(full).all():
        raise ContractError("fitted effects contain NaN or infinity")
    intercept, coefficients = base_rate(gram, full)
    return replace(model, theta=full, intercept=intercept, coefficients=coefficients)


def check_estimator(name: str) -> None:
    """Reject names that no regression stands for, before any job starts."""
    if name not in REGRESSIONS:
        raise ContractError(f"unknown estimator {name!r}; one of {', '.join(REGRESSIONS)}")


def base_rate(gram: Gram, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regress shares minus the price effect on the controls."""
    z, t, y = gram.index(*gram.controls), gram.index("t0", "t1"), gram.index("y0", "y1")
    level_y, slope_y = gram.regress(y, z)
    level_t, slope_t = gram.regress(t, z)
    return level_y - theta @ level_t, slope_y - theta @ slope_t


def collect_gram(df: DataFrame, controls: Sequence[str]) -> tuple[Gram, tuple[int, ...], tuple]:
    """One job: the cross products, and the exact range of both prices observed on the way."""
    seen = Observation()
    ranges = [f(c).alias(f"{f.__name__}{k}") for k, c in enumerate(TREATMENTS) for f in (F.min, F.max)]
    row = weighted_gram(df.observe(seen, *ranges), controls).first()
    if row is None:
        raise ContractError("no rows to fit")
    found = seen.get
    active = tuple(k for k in range(2) if found[f"max{k}"] - found[f"min{k}"] > 1e-10)
    constants = tuple(None if k in active else float(found[f"min{k}"]) for k in range(2))
    return Gram(row["g"], controls), active, constants


def fit_ols(df: DataFrame, controls: Sequence[str], estimator: str = "adjusted_ols", max_condition: float = 1000.0) -> Model:
    gram, active, constants = collect_gram(df, controls)
    return fit_from_gram(gram, estimator, active, constants, max_condition)


def fit_dml(
    df: DataFrame, controls: Sequence[str], fold: str, nuisance: str = "cell_mean",
    cell: Sequence[str] = ("zone_id", "hr"), trees: int = 20, depth: int = 5, min_leaf: int = 5, seed: int = 7,
) -> Model:
    """Double machine learning: out-of-fold residuals, then a 2 x 2 regression, then base rate."""
    gram, active, constants = collect_gram(df, controls)
    if nuisance == "cell_mean":
        sums = cell_mean_moments(df, cell, fold).first()
    elif nuisance == "forest":
        sums = _residual_sums(forest_residuals(df, controls, fold, trees, depth, min_leaf, seed)).first()
    else:
        raise ValueError(f"unknown nuisance {nuisance!r}")
    order = [_pair(i, j) for i in range(4) for j in range(i, 4)]
    return dml_model(gram, np.array([sums[c] or 0.0 for c in ("n", "w", *order)], float), active, constants)


def dml_model(
    gram: Gram, sums: np.ndarray, active: tuple[int, ...] | None = None, constants: tuple[float | None, float | None] = (None, None)
) -> Model:
    """The 2 x 2 regression of out-of-fold residuals and its base rate.

    `sums` has n, w and the upper triangle of the residuals' cross products (prices, then shares).
    """
    active = gram.varying() if active is None else active
    m = np.zeros((4, 4))
    m[np.triu_indices(4)] = sums[2:]
    m += np.triu(m, 1).T
    on = list(active)
    tt = m[np.ix_(on, on)]
    values = np.linalg.eigvalsh(tt / sums[1]) if on and sums[1] > 0 else np.zeros(0)
    rank = int((values > RANK_TOLERANCE).sum())
    model = Model("dml", "ok", gram.controls, gram.n, gram.weight, active, constants, rank=rank)
    if rank < max(len(on), 1):
        return replace(model, status="not_identified", warnings=("cross-fitted residual price lacks rank",))
    theta = np.zeros((2, 2))
    theta[:, on] = np.linalg.solve(tt, m[np.ix_(on, [2, 3])]).T
    intercept, coefficients = base_rate(gram, theta)
    return replace(model, theta=theta, intercept=intercept, coefficients=coefficients, condition=float(values.max() / values.min()))


def identified_effects(model: Model) -> list[float | None]:
    """The four effects, row by row; None for a price that does not vary or lies outside the retained directions."""
    found: list[float | None] = []
    for j in range(2):
        for k in range(2):
            known = k in model.active
            if known and model.basis is not None:
                unit = np.eye(len(model.active))[model.active.index(k)]
                known = np.abs(unit - model.basis @ (model.basis.T @ unit)).max() <= SPAN_TOLERANCE
            found.append(float(model.theta[j, k]) if known else None)
    return found


def forest_residuals(
    df: DataFrame, controls: Sequence[str], fold: str, trees: int, depth: int, min_leaf: int, seed: int
) -> DataFrame:
    """Out-of-fold random-forest residuals r_tx, r_ty, r_yx, r_yy, one forest per fold and target."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    targets = dict(zip(("r_tx", "r_ty", "r_yx", "r_yy"), (*TREATMENTS, *OUTCOMES)))
    wanted = [WEIGHT, *controls, *targets.values()]
    base = df.select("*", F.col(fold).alias("_fold"))
    base = VectorAssembler(inputCols=list(controls), outputCol="_f").transform(
        base.withColumns({c: F.col(c).cast("double") for c in wanted})
    )
    # Read once per forest and by the result: a written table outlives lost executors and holds no cache.
    path = scratch_path(df.sparkSession, "forest-rows")
    base.write.parquet(path)
    base = df.sparkSession.read.schema(base.schema).parquet(path)
    parts = []
    for value in sorted(r[0] for r in base.select("_fold").distinct().collect()):
        held = base.filter(F.col("_fold") == value)
        for r, target in targets.items():
            forest = RandomForestRegressor(
                featuresCol="_f", labelCol=target, weightCol=WEIGHT, predictionCol=f"_p{r}",
                numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed,
            ).fit(base.filter(F.col("_fold") != value))
            held = forest.transform(held).withColumn(r, F.col(target) - F.col(f"_p{r}")).drop(f"_p{r}")
        parts.append(held)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("_fold", "_f")


def _residual_sums(df: DataFrame) -> DataFrame:
    return moments(df, [], ("r_tx", "r_ty", "r_yx", "r_yy"))


# --- prediction and checks ----------------------------------------------------------------

def predict_choice(df: DataFrame, model: Model, log_x: str | Column = TREATMENTS[0], log_y: str | Column = TREATMENTS[1]) -> DataFrame:
    """Add p_x, p_y, p_none; nothing is clipped or renormalized."""
    lx, ly = (F.col(c) if isinstance(c, str) else c for c in (log_x, log_y))
    p = [model.baseline(j) + model.effect(j, lx, ly) for j in range(2)]
    return df.withColumns({"p_x": p[0], "p_y": p[1]}).withColumn("p_none", 1 - F.col("p_x") - F.col("p_y"))


def simplex_rules(tolerance: float = 1e-12) -> dict[str, Column]:
    names = ("p_x", "p_y", "p_none")
    return {
        "nonfinite": any_of([~is_finite(c) for c in names]),
        "outside_unit": any_of([(F.col(c) < 0) | (F.col(c) > 1) for c in names]),
        "sum_not_one": F.abs(F.col("p_x") + F.col("p_y") + F.col("p_none") - 1) > tolerance,
    }


def simplex_violations(df: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    return check_contract(df, simplex_rules(tolerance))


def validation_rmse(df: DataFrame, model: Model) -> DataFrame:
    """Session-weighted root mean squared error of predicted shares, over both services."""
    predicted = predict_choice(df, model)
    error = (F.pow(F.col("p_x") - F.col("q_x"), 2) + F.pow(F.col("p_y") - F.col("q_y"), 2)) / 2
    return predicted.agg(F.sqrt(weighted_mean(error, WEIGHT)).alias("rmse"))


# --- identified contrasts and levels ------------------------------------------------------

def _off_span(model: Model, parts: Sequence[Column]) -> Column:
    """Largest component of a vector outside the retained price directions."""
    inactive = [F.abs(parts[k]) for k in range(2) if k not in model.active]
    if model.basis is not None and model.active:
        gap = np.eye(len(model.active)) - model.basis @ model.basis.T
        on = [parts[k] for k in model.active]
        inactive += [F.abs(total([F.lit(float(g)) * p for g, p in zip(row, on)])) for row in gap]
    return F.greatest(F.lit(0.0), F.lit(0.0), *inactive)


def contrast_identified(contrasts: DataFrame, model: Model, dx: str = "d_log_x", dy: str = "d_log_y") -> DataFrame:
    """Flag each requested log-price change that the fitted directions can answer."""
    off = _off_span(model, [F.col(dx), F.col(dy)])
    return contrasts.withColumn("identified", off <= SPAN_TOLERANCE)


def levels_identified(df: DataFrame, model: Model, log_x: str, log_y: str) -> DataFrame:
    """(n_contexts, max_off_span, identified) for absolute price levels over all contexts."""
    levels = [F.col(log_x), F.col(log_y)]
    centred = []
    for k in range(2):
        if k not in model.active:
            centred.append(levels[k] - F.lit(float(model.constants[k])) if model.basis is not None else F.lit(0.0))
        elif model.anchor is None:
            centred.append(F.lit(0.0))
        else:
            a = model.anchor[model.active.index(k)]
            line = total([F.lit(float(a[0])), *[F.lit(float(b)) * F.col(c) for b, c in zip(a[1:], model.controls)]])
            centred.append(levels[k] - line)
    off = _off_span(model, centred)
    return df.agg(F.count(F.lit(1)).alias("n_contexts"), F.max(off).alias("max_off_span")).withColumn(
        "identified", F.col("max_off_span") <= SPAN_TOLERANCE
    )
