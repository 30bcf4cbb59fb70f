"""SQL text for the check engine: elimination on a matrix, quantiles, exact binomials."""

from __future__ import annotations


def cross_products(z: list[str], y: list[str], w: str, times: str = "1") -> str:
    """Nested list [[sum(w z_i z_j) ..., sum(w z_i y_k) ...] ...] as one select expression."""
    rows = [", ".join(f"SUM({times} * {w} * {a} * {b})" for b in (*z, *y)) for a in z]
    return "[" + ", ".join(f"[{r}]" for r in rows) + "]"


def eliminated(source: str, pivots: int, keys: str = "") -> str:
    """Recursive body: Gauss-Jordan on matrix column m of `source`, one pivot per step.

    A zero pivot (a dummy absent from a resample) is passed over.
    """
    head = f"{keys}, " if keys else ""
    return f"""SELECT {head}0 AS k, m FROM {source} UNION ALL
SELECT {head}k + 1, list_transform(m, lambda r, i: CASE WHEN ABS(m[k + 1][k + 1]) < 1e-9 THEN r WHEN i = k + 1 THEN list_transform(r, lambda x: x / m[k + 1][k + 1])
  ELSE list_transform(r, lambda x, j: x - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM {{name}} WHERE k < {pivots}"""


def t_cdf(x: str, df: str) -> str:
    """Student-t distribution at x >= 0: Simpson's rule after t = sqrt(df) tan(a)."""
    a = f"atan({x} / sqrt({df}))"
    weight = "CASE WHEN j IN (0, 200) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END"
    return (
        f"(0.5 + exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * {a} / 600 * "
        f"list_sum(list_transform(range(0, 201), lambda j: {weight} * pow(cos({a} * j / 200.0), {df} - 1))))"
    )


def normal_cdf(x: str) -> str:
    """Standard normal distribution: Simpson's rule from 0."""
    weight = "CASE WHEN j IN (0, 200) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END"
    return f"(0.5 + {x} / 600 * list_sum(list_transform(range(0, 201), lambda j: {weight} * exp(-POW({x} * j / 200.0, 2) / 2))) / sqrt(2 * pi()))"


def normal_quantiles(source: str) -> str:
    """Recursive body over (id, p): bisection for the normal quantile."""
    mid = "((lo + hi) / 2)"
    return f"""SELECT id, p, -8.0::DOUBLE AS lo, 8.0::DOUBLE AS hi, 0 AS step FROM {source} UNION ALL
SELECT id, p, CASE WHEN c < p THEN {mid} ELSE lo END, CASE WHEN c < p THEN hi ELSE {mid} END, step + 1
FROM (SELECT *, {normal_cdf(mid)} AS c FROM {{name}} WHERE step < 48)"""


def t_quantiles(source: str) -> str:
    """Recursive body over (id, p, df) with p >= 0.5: bisection for the t quantile."""
    mid = "((lo + hi) / 2)"
    return f"""SELECT id, p, df, 0.0::DOUBLE AS lo, 200.0::DOUBLE AS hi, 0 AS step FROM {source} UNION ALL
SELECT id, p, df, CASE WHEN c < p THEN {mid} ELSE lo END, CASE WHEN c < p THEN hi ELSE {mid} END, step + 1
FROM (SELECT *, {t_cdf(mid, "df")} AS c FROM {{name}} WHERE step < 48)"""


def binomial_terms(n: str, p: str, low: str, high: str) -> str:
    """Sum of binomial probabilities for outcomes low..high inclusive, 0 < p < 1."""
    log = f"lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) + i * ln({p}) + ({n} - i) * ln(1 - {p})"
    return f"COALESCE(list_sum(list_transform(range({low}, {high} + 1), lambda i: exp({log}))), 0)"


def clopper_bounds(source: str, level: float = 0.95) -> str:
    """Recursive body over (id, k, n): bisection on binomial tails for both exact bounds."""
    tail = (1 - level) / 2
    lo_mid, hi_mid = "((ll + lh) / 2)", "((ul + uh) / 2)"
    at_least = binomial_terms("n", lo_mid, "k", "n")
    at_most = binomial_terms("n", hi_mid, "0", "k")
    return f"""SELECT id, k, n, 0.0::DOUBLE AS ll, 1.0::DOUBLE AS lh, 0.0::DOUBLE AS ul, 1.0::DOUBLE AS uh, 0 AS step FROM {source} WHERE n > 0 UNION ALL
SELECT id, k, n, CASE WHEN a < {tail!r} THEN {lo_mid} ELSE ll END, CASE WHEN a < {tail!r} THEN lh ELSE {lo_mid} END,
  CASE WHEN b > {tail!r} THEN {hi_mid} ELSE ul END, CASE WHEN b > {tail!r} THEN uh ELSE {hi_mid} END, step + 1
FROM (SELECT *, {at_least} AS a, {at_most} AS b FROM {{name}} WHERE step < 40)"""


def binomial_two_sided(k: str, n: str, p: str) -> str:
    """Exact two-sided p-value by adding every outcome no likelier than k."""
    log = lambda i: f"lgamma({n} + 1.0) - lgamma({i} + 1.0) - lgamma({n} - {i} + 1.0) + {i} * ln({p}) + ({n} - {i}) * ln(1 - {p})"
    return (
        f"LEAST(1.0, list_sum(list_transform(range(0, {n} + 1), lambda i: "
        f"CASE WHEN {log('i')} <= {log(k)} + 1e-7 THEN exp({log('i')}) ELSE 0 END)))"
    )


def recursive(**bodies: str) -> dict[str, str]:
    """Fill the self-reference placeholder of each recursive body with its own name."""
    return {name: body.replace("{name}", name) for name, body in bodies.items()}
