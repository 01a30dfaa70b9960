"""Telemetry series: summaries, rates and comparisons per second."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import selection


def telemetry_series(df: DataFrame, label: str, pid: int | None = None) -> DataFrame:
    """One label's series, of one process if asked."""
    own = df.where(F.col("label") == label)
    return (own if pid is None else own.where(F.col("pid") == pid)).select("time", "measurement", "label", "pid")


def series_summary(df: DataFrame, by: tuple[str, ...] = ("label",), exact: bool = True, few: int = selection.FEW) -> DataFrame:
    """count, mean, std, min, percentiles and max of each series. Exact percentiles come by selection, which sorts ``few`` values of
    a series at once at most; exact=False takes them from one sketch, in one pass."""
    at = [0.25, 0.5, 0.75, 0.9, 0.95]
    sketch = [] if exact else [F.approx_percentile("measurement", at, 10_000).alias("_p")]
    found = df.groupBy(*by).agg(
        F.count("measurement").alias("n"), F.avg("measurement").alias("mean"), F.stddev("measurement").alias("std"), F.min("measurement").alias("min"), F.max("measurement").alias("max"), *sketch,
    )
    if exact:
        found = found.withColumn("_g", F.struct(*by, F.lit(0).alias("_"))).join(selection.percentiles(df, by, "measurement", at, few), "_g", "left")
    return found.select(*by, "n", "mean", "std", "min", *[F.col("_p")[k].alias(f"p{round(100 * x)}") for k, x in enumerate(at)], "max")


def measurements_per_second(df: DataFrame) -> DataFrame:
    """Measurements of each label in each second from its first to its last; a second without any has 0, a NULL label is one.

    Each second that has some makes the empty ones up to the next as well, so the dense grid is neither joined nor shuffled;
    hours are dealt out before their seconds are made, so that a long gap is shared by many tasks."""
    spark = df.sparkSession
    counts = df.where("time is not null").groupBy("label", F.date_trunc("second", "time").alias("second")).agg(F.count("*").alias("n")).withColumn("hour", F.date_trunc("hour", "second"))
    hours = counts.groupBy("label", "hour").agg(F.min("second").alias("_first"))
    hours = hours.select(F.col("label").alias("_label"), F.col("hour").alias("_hour"), F.lead("_first").over(Window.partitionBy("label").orderBy("hour")).alias("_later"))
    within = F.lead("second").over(Window.partitionBy("label", "hour").orderBy("second"))
    rows = counts.withColumn("_next", within).join(hours, F.col("label").eqNullSafe(F.col("_label")) & (F.col("hour") == F.col("_hour")))
    last = F.coalesce("_next", "_later", F.col("second") + F.expr("interval 1 second")) - F.expr("interval 1 second")
    gaps = rows.select("label", "second", "n", last.alias("last")).select("*", F.explode(F.sequence(F.date_trunc("hour", "second"), "last", F.expr("interval 1 hour"))).alias("hour"))
    gaps = gaps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "hour")
    ends = F.least(F.col("last"), F.col("hour") + F.expr("interval 3599 seconds"))
    each = gaps.select("label", F.col("second").alias("_at"), "n", F.explode(F.sequence(F.greatest("second", "hour"), ends, F.expr("interval 1 second"))).alias("second"))
    return each.select("label", "second", F.when(F.col("second") == F.col("_at"), F.col("n")).otherwise(0).alias("n"))


def _sums(df: DataFrame, label: str, name: str) -> DataFrame:
    own = df.where(F.col("label") == label)
    return own.groupBy(F.date_trunc("second", "time").alias("second")).agg(F.sum("measurement").alias(name))


def _both(df: DataFrame, first: str, second: str) -> DataFrame:
    return _sums(df, first, "a").join(_sums(df, second, "b"), "second", "full").select("second", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


def sum_by_second_difference(df: DataFrame, first: str, second: str) -> DataFrame:
    """Per second, the sum of one series less that of another; a series without a value there counts 0."""
    return _both(df, first, second).select("second", (F.col("a") - F.col("b")).alias("difference"))


def sum_by_second_ratio(df: DataFrame, first: str, second: str) -> DataFrame:
    """Per second, the sum of one series over that of another; NULL where the latter is 0."""
    return _both(df, first, second).select("second", F.when(F.col("b") != 0, F.col("a") / F.col("b")).alias("ratio"))


def total_ratio(df: DataFrame, first: str, second: str) -> DataFrame:
    total = lambda label: F.sum(F.when(F.col("label") == label, F.col("measurement")))
    return df.agg((total(first) / total(second)).alias("ratio"))


def insert_delta(df: DataFrame, by: str = "label", time: str = "time", value: str = "measurement", tie: tuple[str, ...] = (), period: str = "day") -> DataFrame:
    """Each sample with its growth since the one before. A series is ordered period by period, each of which gets the last
    value of the one before it, so a long series is shared by many tasks."""
    own = df.withColumn("_period", F.date_trunc(period, time))
    last = own.groupBy(by, "_period").agg(F.max(F.struct(time, *tie, value))[value].alias("_last"))
    last = last.select(F.col(by).alias("_by"), F.col("_period").alias("_at"), F.lag("_last").over(Window.partitionBy(by).orderBy("_period")).alias("_before"))
    inside = Window.partitionBy(by, "_period").orderBy(time, *tie)
    rows = own.withColumns({"_first": F.row_number().over(inside) == 1, "_lag": F.lag(value).over(inside)})
    rows = rows.join(last, F.col(by).eqNullSafe(F.col("_by")) & F.col("_period").eqNullSafe(F.col("_at")), "left")
    return rows.select(*df.columns, (F.col(value) - F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag"))).alias("delta"))
