"""Exact grouped operators that never need one whole group in one task.

A zone, vehicle or day may own a third of a fact table. Ordinary aggregates survive that
through partial aggregation; order statistics and neighbour look-ups do not. The helpers
here split such groups and stay exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farewise.functions.scalars import any_of, total
from farewise.session import scratch_path

SKETCH_ACCURACY = 10_000
#: Rows up to which a group's values are summarized as they are: a megabyte or less a group and metric.
EXACT_ROWS = 10_000
#: Pieces in which a bracket is ranked.
PIECES = 64


@dataclass(frozen=True)
class Quantile:
    """One requested order statistic: `name` = quantile `prob` of `value` where `valid`."""

    name: str
    value: str
    prob: float
    valid: str | None = None

    @property
    def source(self) -> Column:
        value = F.col(self.value).cast("double")
        return F.when(F.col(self.valid), value) if self.valid else value


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on keys where NULL matches NULL, keeping the left key columns once."""
    a, b = left.alias("a"), right.alias("b")
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    kept = [F.col(f"b.{c}") for c in right.columns if c not in keys]
    return a.join(b, condition, how).select("a.*", *kept)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: Sequence[Quantile], extra: Sequence[Column] = ()
) -> DataFrame:
    """Linear-interpolated quantiles per group plus `extra` aggregates in one table.

    A first aggregate counts the groups' rows, beside `extra`, and is stored. Groups of up to EXACT_ROWS rows are
    read off a mergeable summary of their values, which at that size is exact; only the rows of larger ones are
    sketched and ranked by `bracketed_quantiles`. Both give the same values.
    """
    keys = list(keys)
    if not keys:
        found = bracketed_quantiles(df, keys, wanted)
        return _beside(df.agg(*extra), found) if extra else found
    metrics = list(dict.fromkeys((q.value, q.valid) for q in wanted))
    source = {(q.value, q.valid): q.source for q in wanted}
    sizes = df.groupBy(*keys).agg(*extra, *[F.count(source[m]).alias(f"_n{i}") for i, m in enumerate(metrics)])
    path = scratch_path(df.sparkSession, "group-sizes")
    sizes.write.parquet(path)
    sizes = df.sparkSession.read.schema(sizes.schema).parquet(path)
    large = sizes.filter(any_of([F.col(f"_n{i}") > EXACT_ROWS for i in range(len(metrics))])).select(*keys)
    if large.isEmpty():
        found = _summarized(df, keys, wanted)
    else:
        small = _summarized(null_safe_join(df, large, keys, "left_anti"), keys, wanted)
        found = small.unionByName(bracketed_quantiles(null_safe_join(df, large, keys, "left_semi"), keys, wanted))
    return null_safe_join(sizes.drop(*[f"_n{i}" for i in range(len(metrics))]), found, keys, "left")


def _summarized(df: DataFrame, keys: Sequence[str], wanted: Sequence[Quantile]) -> DataFrame:
    """Quantiles of groups of bounded size: counts by value, merged over tasks."""
    probs: dict[tuple[str, str | None], list[float]] = {}
    for q in wanted:
        probs.setdefault((q.value, q.valid), []).append(q.prob)
    source = {(q.value, q.valid): q.source for q in wanted}
    states = [F.percentile(source[m], F.array(*map(F.lit, ps))).alias(f"_p{i}") for i, (m, ps) in enumerate(probs.items())]
    place = {(m, p): F.col(f"_p{i}")[ps.index(p)] for i, (m, ps) in enumerate(probs.items()) for p in ps}
    return df.groupBy(*keys).agg(*states).select(*keys, *[place[(q.value, q.valid), q.prob].alias(q.name) for q in wanted])


def bracketed_quantiles(df: DataFrame, keys: Sequence[str], wanted: Sequence[Quantile]) -> DataFrame:
    """Linear-interpolated quantiles of groups of any size.

    A first aggregate sketches each metric, which brackets every target rank within two sketch steps (groups too
    small for that are bracketed by their range). A second pass counts the values of the gaps between brackets as one
    number each and the values inside by value. A group's bracket is ranked in PIECES consecutive pieces that meet
    only as totals, so no task ranks a whole bracket.
    """
    keys = list(keys)
    probs: dict[tuple[str, str | None], list[float]] = {}
    for q in wanted:
        probs.setdefault((q.value, q.valid), [])
        if q.prob not in probs[(q.value, q.valid)]:
            probs[(q.value, q.valid)].append(q.prob)
    metrics = list(probs)
    source = {(q.value, q.valid): q.source for q in wanted}
    step = 2.0 / SKETCH_ACCURACY
    sketches = []
    for i, m in enumerate(metrics):
        probs[m].sort()
        ends = [F.lit(e) for p in probs[m] for e in (max(0.0, p - step), min(1.0, p + step))]
        state = F.percentile_approx(source[m], F.array(*ends), F.lit(SKETCH_ACCURACY))
        sketches.append(F.struct(F.count(source[m]).alias("n"), F.min(source[m]).alias("least"), F.max(source[m]).alias("most"), state.alias("ends")).alias(f"_s{i}"))
    brackets = df.groupBy(*keys).agg(*sketches)
    joined = null_safe_join(df, brackets, keys, "inner") if keys else _beside(df, brackets)
    places = []
    for i, m in enumerate(metrics):
        s, v = F.col(f"_s{i}"), source[m]
        small = s["n"] < 4 * SKETCH_ACCURACY
        lows = [F.when(small, s["least"]).otherwise(s["ends"][2 * k]) for k in range(len(probs[m]))]
        highs = [F.when(small, s["most"]).otherwise(s["ends"][2 * k + 1]) for k in range(len(probs[m]))]
        passed = total([(v > h).cast("int") for h in highs])
        inside = any_of([(v >= lo) & (v <= hi) for lo, hi in zip(lows, highs, strict=True)])
        low, high = (F.coalesce(*[F.when(passed == k, e) for k, e in enumerate(es)]) for es in (lows, highs))
        part = F.least(F.lit(PIECES - 1), F.greatest(F.lit(0), F.floor(PIECES * (v - low) / F.nullif(high - low, F.lit(0.0)))))
        piece = F.when(inside, F.coalesce(part, F.lit(0))).otherwise(-1).cast("int")
        place = F.struct(F.lit(i).alias("m"), passed.alias("pos"), piece.alias("piece"), F.when(inside, v).alias("v"))
        places.append(F.when(v.isNotNull(), place))
    each = F.explode(F.filter(F.array(*places), lambda x: x.isNotNull())).alias("x")
    counts = joined.select(*keys, each).select(*keys, "x.*").groupBy(*keys, "m", "pos", "piece", "v").agg(F.count(F.lit(1)).alias("c"))
    group, cell = [*keys, "m"], [*keys, "m", "pos", "piece"]
    along = Window.partitionBy(*group).orderBy("pos", "piece")
    totals = counts.groupBy(*cell).agg(F.sum("c").alias("sum"))
    totals = totals.select(
        *cell,
        (F.sum("sum").over(along) - F.col("sum")).alias("before"),
        F.sum("sum").over(Window.partitionBy(*group)).alias("n"),
    )
    inner = counts.filter("v is not null").withColumn("upto", F.sum("c").over(Window.partitionBy(*cell).orderBy("v")))
    ranked = null_safe_join(inner, totals, cell, "inner").withColumn("upto", F.col("upto") + F.col("before"))
    picks, values = [], []
    for j, q in enumerate(wanted):
        rank = F.lit(q.prob) * (F.col("n") - 1)
        own = F.col("m") == metrics.index((q.value, q.valid))
        holds = lambda r, own=own: own & (F.col("upto") >= r) & (F.col("upto") - F.col("c") < r)
        picks += [
            F.max(F.when(holds(F.floor(rank) + 1), F.col("v"))).alias(f"_a{j}"),
            F.max(F.when(holds(F.ceil(rank) + 1), F.col("v"))).alias(f"_b{j}"),
            F.max(F.when(own, rank - F.floor(rank))).alias(f"_f{j}"),
        ]
        values.append((F.col(f"_a{j}") + F.col(f"_f{j}") * (F.col(f"_b{j}") - F.col(f"_a{j}"))).alias(q.name))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *values)


def _beside(df: DataFrame, row: DataFrame) -> DataFrame:
    """The columns of a one-row table on every row of `df`."""
    return df.withColumn("_row", row.select(F.struct(*row.columns)).scalar()).select(*df.columns, "_row.*")


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    columns: Sequence[str],
    out: str,
    ahead: bool = True,
) -> DataFrame:
    """Add struct `out` holding `columns` of the next (or previous) row of the same entity.

    `chunk` cuts an entity's ordered rows into consecutive pieces (a day, an hour). Sorting
    happens inside a piece; only the rows at a piece's edge consult the edge table, which
    has one row per entity and piece. `out` is NULL at the end of the entity's rows.
    """
    keys = list(keys)
    values = F.struct(*columns)
    ordering = [F.col(c) if ahead else F.col(c).desc() for c in order]
    piece = Window.partitionBy(*keys, "_chunk").orderBy(*ordering)
    cut = df.withColumn("_chunk", chunk)
    inner = cut.withColumn("_near", F.lead(values).over(piece))
    # Edges come from the unsorted rows by partial aggregation. Asking only for the leading order
    # column keeps a primitive state, so that aggregation hashes instead of sorting.
    if list(columns) == [order[0]]:
        edge = F.struct((F.min if ahead else F.max)(order[0]).alias(order[0]))
    else:
        edge = (F.min_by if ahead else F.max_by)(values, F.struct(*order))
    edges = cut.groupBy(*keys, "_chunk").agg(edge.alias("_edge"))
    along = F.col("_chunk") if ahead else F.col("_chunk").desc()
    edges = edges.select(
        *keys,
        "_chunk",
        F.lead("_edge").over(Window.partitionBy(*keys).orderBy(along)).alias("_far"),
    )
    return (
        inner.join(edges, [*keys, "_chunk"], "left")
        .withColumn(out, F.coalesce("_near", "_far"))
        .drop("_chunk", "_near", "_far")
    )


def with_running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: str, out: str
) -> DataFrame:
    """Add the maximum of `value` over all earlier rows of the same entity, piece by piece."""
    keys = list(keys)
    piece = (
        Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    cut = df.withColumn("_chunk", chunk)
    inner = cut.withColumn("_here", F.max(value).over(piece))
    earlier = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.max(value).alias("_top"))
        .select(*keys, "_chunk", F.max("_top").over(earlier).alias("_before"))
    )
    return (
        inner.join(carried, [*keys, "_chunk"], "left")
        .withColumn(out, F.greatest("_here", "_before"))
        .drop("_chunk", "_here", "_before")
    )
