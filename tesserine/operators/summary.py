"""Summaries of run rows by many dimensions in one pass: rates with intervals, means, exact percentiles, throughput."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S

ALL = "all"
#: How far from a percentile, as a share of the rows, a value may be for its exact rank to be looked for.
SLACK, ACCURACY = 0.0005, 10_000


@dataclass(frozen=True)
class Measures:
    """What is summed up. rates: name to (hit, counted): rows that count have a non-null hit and `counted` true. means and
    totals: name to a number; null is left out. seconds: columns whose mean, median and nearest-rank 95th percentile are
    wanted. hours: name to a column of seconds, for rows an hour of that time. No name is dimension, value or n."""

    rates: dict[str, tuple[Column, Column | None]] = field(default_factory=dict)
    means: dict[str, Column] = field(default_factory=dict)
    totals: dict[str, Column] = field(default_factory=dict)
    seconds: tuple[str, ...] = ()
    hours: dict[str, str] = field(default_factory=dict)


def _named(dims: dict[str, Column], also: int = 0) -> tuple[Column, Column]:
    """The dimension of a grouping set of one column (and `also` further ones that all sets have), and its value as text."""
    names, ids = list(dims), F.shiftright(F.grouping_id(), also)
    whole = 2 ** len(names) - 1
    dimension, value = F.lit(ALL), F.lit(ALL)
    for i, name in enumerate(names):
        own = ids == whole - 2 ** (len(names) - 1 - i)
        dimension, value = F.when(own, name).otherwise(dimension), F.when(own, F.coalesce(F.col(f"d_{name}"), F.lit("NOT_AVAILABLE"))).otherwise(value)
    return dimension.alias("dimension"), value.alias("value")


def group_summary(rows: DataFrame, dims: dict[str, Column], measures: Measures, least: dict[str, int] | None = None) -> DataFrame:
    """One row for all rows and one for each value of each dimension: dimension, value, n and, for each measure,

    rate: <name>_n, <name>_hits, <name> with <name>_low and <name>_high (Wilson); mean: <name>_n, <name>; total: <name>;
    seconds: <name>_n, _mean, _median, _p95; hours: <name>_per_hour (null where no time passed). What nothing counts for is
    null. Values of a dimension with fewer rows than least[dimension] are left out. A null value of a dimension is
    NOT_AVAILABLE. No rows give no row.

    All sums are one GROUPING SETS plan, combined in the tasks. Percentiles are exact: the same pass bounds the values near
    each one, and only those, counted by value, are put in order.
    """
    names = list(dims)
    base = rows.withColumns({f"d_{n}": c.cast("string") for n, c in dims.items()}).withColumns({f"s_{c}": F.col(c).cast("double") for c in measures.seconds})
    columns = [F.col(f"d_{n}") for n in names]
    sets = [[], *[[c] for c in columns]]
    aggregates: list[Column] = [F.count("*").alias("n")]
    for name, (hit, counted) in measures.rates.items():
        counts = hit.isNotNull() & (F.coalesce(counted, F.lit(False)) if counted is not None else F.lit(True))
        aggregates += [F.count_if(counts).alias(f"{name}_n"), F.count_if(counts & hit).alias(f"{name}_hits")]
    for name, c in measures.means.items():
        aggregates += [F.count(c).alias(f"{name}_n"), F.avg(c).alias(name)]
    aggregates += [F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in measures.totals.items()]
    ends = [0.5 - SLACK, 0.5 + SLACK, 0.95 - SLACK, 0.95 + SLACK]
    for c in measures.seconds:
        aggregates += [F.count(f"s_{c}").alias(f"{c}_n"), F.avg(f"s_{c}").alias(f"{c}_mean"), F.percentile_approx(f"s_{c}", ends, ACCURACY).alias(f"b_{c}")]
    aggregates += [F.sum(c).alias(f"h_{name}") for name, c in measures.hours.items()]
    dimension, value = _named(dims)
    out = base.groupingSets(sets, *columns).agg(dimension, value, *aggregates).drop(*[f"d_{n}" for n in names])
    for name, low in (least or {}).items():
        out = out.where((F.col("dimension") != name) | (F.col("n") >= low))
    if measures.seconds:
        found = _percentiles(base, out, columns, sets, dims, measures.seconds)
        out = out.join(found, ["dimension", "value"], "left")
    shown: list[Column | str] = ["dimension", "value", "n"]
    for name in measures.rates:
        low, high = S.wilson(F.col(f"{name}_hits"), F.col(f"{name}_n"))
        shown += [f"{name}_n", f"{name}_hits", F.round(S.share(F.col(f"{name}_hits"), F.col(f"{name}_n")), 6).alias(name), F.round(low, 6).alias(f"{name}_low"), F.round(high, 6).alias(f"{name}_high")]
    for name in measures.means:
        shown += [f"{name}_n", F.round(name, 6).alias(name)]
    shown += list(measures.totals)
    for c in measures.seconds:
        shown += [f"{c}_n", F.round(f"{c}_mean", 6).alias(f"{c}_mean"), F.round(f"{c}_median", 6).alias(f"{c}_median"), F.round(f"{c}_p95", 6).alias(f"{c}_p95")]
    shown += [F.round(F.when(F.col(f"h_{name}") > 0, F.col("n") / F.col(f"h_{name}") * 3600.0), 4).alias(f"{name}_per_hour") for name in measures.hours]
    return out.select(*shown)


def _percentiles(base: DataFrame, bounds: DataFrame, columns: list[Column], sets: list, dims: dict[str, Column], seconds: tuple[str, ...]) -> DataFrame:
    """dimension, value, <column>_median and <column>_p95 of all seconds columns at once."""
    each = base.select(*columns, F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(f"s_{c}").alias("x")) for c in seconds])).alias("m")).select(*columns, "m.*").where("x is not null")
    dimension, value = _named(dims, 2)
    counts = each.groupingSets([[*s, F.col("what"), F.col("x")] for s in sets], *columns, F.col("what"), F.col("x")).agg(dimension, value, F.count("*").alias("c")).drop(*[f"d_{n}" for n in dims])
    ranges = F.array(*[
        F.struct(F.lit(c).alias("what"), F.lit(q).alias("quantile"), F.col(f"b_{c}")[2 * i].alias("low"), F.col(f"b_{c}")[2 * i + 1].alias("high"), *[r.alias(f"rank{k}") for k, r in enumerate(ranks(F.col(f"{c}_n")))])
        for c in seconds for i, (q, ranks) in enumerate(_RANKS.items())
    ])
    near = bounds.select("dimension", "value", F.explode(ranges).alias("r")).select("dimension", "value", "r.*")
    joined = counts.join(near, ["dimension", "value", "what"])
    key = ["dimension", "value", "what", "quantile"]
    below = joined.groupBy(*key).agg(F.coalesce(F.sum(F.when(F.col("x") < F.col("low"), F.col("c"))), F.lit(0)).alias("below"))
    inside = joined.where(F.col("x").between(F.col("low"), F.col("high"))).join(below, key)
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*key).orderBy("x"))
    inside = inside.withColumn("upto", upto)
    at = [F.min(F.when(F.col("upto") >= F.col(f"rank{k}"), F.col("x"))) for k in (0, 1)]
    values = inside.groupBy(*key).agg(((at[0] + at[1]) / 2).alias("at"))
    return values.groupBy("dimension", "value").agg(*[F.max(F.when((F.col("what") == c) & (F.col("quantile") == q), F.col("at"))).alias(f"{c}_{q}") for c in seconds for q in _RANKS])


#: Ranks (from 1) of n values whose mean is the percentile: both middle ones, and the nearest rank.
_RANKS = {"median": lambda n: [F.floor((n + 1) / 2), F.ceil((n + 1) / 2)], "p95": lambda n: [F.ceil(n * 0.95 - 1e-9)] * 2}
