"""Exact percentiles of long series by narrowing intervals, in memory that does not grow with the values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Values that are sorted at once, and cells of a sketch.
FEW, CELLS = 20_000, 256
_KEYS = ["_g", "_j"]


def _bounds(state: DataFrame) -> DataFrame:
    """For each target the values of the sketch two cells below and above its rank."""
    place = lambda t: t["k"] / F.greatest(F.col("n") - 1, F.lit(1)) * CELLS
    low = lambda t: F.get("_s", F.greatest(F.floor(place(t)) - 2, F.lit(0)).cast("int"))
    high = lambda t: F.get("_s", F.least(F.ceil(place(t)) + 2, F.lit(CELLS)).cast("int"))
    return state.select(*_KEYS, "n", F.transform("_t", lambda t: F.struct(t["j"].alias("j"), t["k"].alias("k"), low(t).alias("lo"), high(t).alias("hi"))).alias("_t"))


def _outcome(t: Column, n: Column, below: Column, at_low: Column, inside: Column, at_high: Column) -> Column:
    """The target's value if it is one of its bounds, else the open interval where it is, its rank and the values there."""
    k, none = t["k"], F.lit(None).cast("double")
    to_inside, to_high = below + at_low, below + at_low + inside
    is_low, is_high = (k >= below) & (k < to_inside), (k >= to_high) & (k < to_high + at_high)
    case = lambda first, middle, rest: F.when(k < below, first).when(k < to_high, middle).otherwise(rest)
    return F.struct(
        t["j"].alias("j"), F.when(is_low, t["lo"]).when(is_high, t["hi"]).alias("x"), case(none, t["lo"], t["hi"]).alias("a"), case(t["lo"], t["hi"], none).alias("b"),
        case(k, k - to_inside, k - to_high - at_high).alias("k"), case(below, inside, n - to_high - at_high).alias("n"),
    )


def select_ranks(values: DataFrame, ranks: list[Column], few: int = FEW) -> DataFrame:
    """(_g, n, _r): of the values ``_x`` of each ``_g``, their number and those at ``ranks`` (from 0, by ``n``) in order.

    A sketch of bounded size gives an interval about each rank, and a count of the values below, at and between its
    ends tells exactly which of these holds the rank. Only values strictly between go on, a hundredth of them or so, until
    at most ``few`` are left to be sorted. Each interval leaves out its ends, so it shrinks on any values, ties included."""
    grid = [c / CELLS for c in range(CELLS + 1)]
    sketch = lambda rows: rows.groupBy(*_KEYS).agg(F.count("*").alias("n"), F.approx_percentile("_x", grid, 10_000).alias("_s"))
    rows = values.select("_g", F.lit(-1).alias("_j"), "_x")
    state = stored(sketch(rows).withColumn("_t", F.array(*[F.struct(F.lit(j).alias("j"), r.cast("long").alias("k")) for j, r in enumerate(ranks)])))
    sizes, found, width = state.select("_g", "n"), [], len(ranks)
    while True:
        ready = rows.join(state.where(F.col("n") <= few).select(*_KEYS, "_t"), _KEYS).groupBy(*_KEYS).agg(F.sort_array(F.collect_list("_x")).alias("_all"), F.first("_t").alias("_t"))
        found.append(ready.select("_g", F.explode(F.transform("_t", lambda t: F.struct(t["j"].alias("j"), F.get("_all", t["k"].cast("int")).alias("x")))).alias("o")).select("_g", "o.j", "o.x"))
        if state.where(F.col("n") > few).isEmpty():
            break
        near = rows.join(_bounds(state.where(F.col("n") > few)), _KEYS)
        x, counts = F.col("_x"), []
        for w in range(width):
            lo, hi = F.col("_t")[w]["lo"], F.col("_t")[w]["hi"]
            counts += [F.count_if(c).alias(f"_{name}{w}") for name, c in (("below", x < lo), ("low", x == lo), ("inside", (x > lo) & (x < hi)), ("high", (x == hi) & (hi > lo)))]
        counted = near.groupBy(*_KEYS).agg(F.first("_t").alias("_t"), F.first("n").alias("n"), *counts)
        outcome = stored(counted.select(*_KEYS, F.array(*[_outcome(F.col("_t")[w], F.col("n"), *[F.col(f"_{c}{w}") for c in ("below", "low", "inside", "high")]) for w in range(width)]).alias("_o")))
        each = outcome.select("_g", F.explode("_o").alias("o"))
        found.append(each.where("o.x is not null").select("_g", "o.j", "o.x"))
        still = outcome.select(*_KEYS, F.filter("_o", lambda o: o["x"].isNull()).alias("_o")).where(F.size("_o") > 0)
        meets = lambda o: (o["a"].isNull() | (F.col("_x") > o["a"])) & (o["b"].isNull() | (F.col("_x") < o["b"]))
        rows = stored(rows.join(still, _KEYS).select("_g", F.explode(F.filter("_o", meets)).alias("o"), "_x").select("_g", F.col("o.j").alias("_j"), "_x"))
        targets = each.where("o.x is null").select("_g", F.col("o.j").alias("_j"), F.array(F.struct("o.j", "o.k")).alias("_t"))
        state, width = stored(sketch(rows).join(targets, _KEYS)), 1
    ordered = reduce(DataFrame.unionByName, found).groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("_r"))
    return ordered.join(sizes, "_g").select("_g", "n", F.transform("_r", lambda r: r["x"]).alias("_r"))


def percentiles(df: DataFrame, by: tuple[str, ...], value: str, at: list[float], few: int = FEW) -> DataFrame:
    """(_g, _p): for each group, a struct of ``by``, the exact percentiles ``at``, between two values in proportion. NULL values don't
    count; a group without values has no row; NULLs in ``by`` are a group; NaN is above all."""
    values = df.where(F.col(value).isNotNull()).select(F.struct(*by, F.lit(0).alias("_")).alias("_g"), F.col(value).cast("double").alias("_x"))
    place = [F.lit(p) * (F.col("n") - 1) for p in at]
    found = select_ranks(values, [f(p) for p in place for f in (F.floor, F.ceil)], few)
    between = lambda k, p: F.when(F.get("_r", F.lit(2 * k)) == F.get("_r", F.lit(2 * k + 1)), F.get("_r", F.lit(2 * k))).otherwise((F.ceil(p) - p) * F.get("_r", F.lit(2 * k)) + (p - F.floor(p)) * F.get("_r", F.lit(2 * k + 1)))
    return found.select("_g", F.array(*[between(k, p) for k, p in enumerate(place)]).alias("_p"))
