"""Questions to series tables: history, aggregates, last values, paging, listings, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import period_start
from .filters import METHODS

KEY = ("entity_type", "entity_id")
MAX_ROWS = 10_000


def unique(names) -> list[str]:
    """Names without repeats, in their first order."""
    return list(dict.fromkeys(names))


def check_aggregable(df: DataFrame, attrs: list[str], method: str) -> None:
    """sum and avg take numbers only; count, min and max take text and booleans too."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    for a in attrs:
        if method in ("sum", "avg") and not isinstance(df.schema[a].dataType, T.NumericType):
            raise ValueError(f"{method} can't be applied to {a}, which is {df.schema[a].dataType.simpleString()}")


def _aggregates(df: DataFrame, attrs: list[str], method: str) -> list[Column]:
    check_aggregable(df, unique(attrs), method)
    return [getattr(F, method)(a).alias(a) for a in unique(attrs)]


def aggregate_entities(df: DataFrame, attrs: list[str], method: str) -> DataFrame:
    """One aggregate of attributes for each entity; count counts values that are not NULL."""
    return df.groupBy(*KEY).agg(*_aggregates(df, attrs, method))


def aggregate_by_period(df: DataFrame, attrs: list[str], method: str, period: str) -> DataFrame:
    """One aggregate of attributes for each entity and calendar period; time_index is the period's start."""
    return df.groupBy(*KEY, period_start(period, F.col("time_index")).alias("time_index")).agg(*_aggregates(df, attrs, method))


def aggregate_global(df: DataFrame, attrs: list[str], method: str, period: str | None = None) -> DataFrame:
    """One aggregate across the entities of each type, with the sorted ids that took part."""
    keys = ["entity_type"] + ([period_start(period, F.col("time_index")).alias("time_index")] if period else [])
    return df.groupBy(*keys).agg(*_aggregates(df, attrs, method), F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))


def history(df: DataFrame, attrs: list[str] | None = None) -> DataFrame:
    """Rows with the chosen attributes (all without a choice), ordered by time within each entity."""
    columns = df.columns if attrs is None else [*KEY, "time_index", *unique(attrs)]
    return df.select(*columns).orderBy(*KEY, "time_index")


def _ranked(df: DataFrame, by: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def _newest(df: DataFrame, tie: list[str]) -> list[Column]:
    return [F.desc("time_index"), *[F.col(t) for t in tie]]


def last_n(df: DataFrame, n: int, scope: str = "type", tie: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """The newest n rows of each type, or with scope="entity" of each entity. ``tie`` orders rows of one time.

    Spark cuts each sorted run to n rows before it shuffles them, so a large type doesn't meet in one task whole."""
    by = ["entity_type"] if scope == "type" else list(KEY)
    return df.withColumn("_rank", _ranked(df, by, _newest(df, list(tie)))).where(F.col("_rank") <= n).drop("_rank")


def last_n_per_entity(df: DataFrame, n: int, tie: tuple[str, ...] = ()) -> DataFrame:
    return last_n(df, n, "entity", tie)


def paginate(df: DataFrame, limit: int = MAX_ROWS, offset: int = 0, last: int | None = None, tie: tuple[str, ...] = ("entity_id",), max_rows: int = MAX_ROWS) -> DataFrame:
    """Rows offset+1 to offset+limit of each type in time order; with ``last``, of the newest rows, ascending.

    A page has ``max_rows`` rows of a type at most, whatever the limit; further ones come with a larger offset or by ``page_after``."""
    limit = min(limit, max_rows) if last is None else min(limit, last, max_rows)
    order = [F.asc("time_index"), *[F.col(t) for t in tie]] if last is None else _newest(df, list(tie))
    return df.withColumn("_rank", _ranked(df, ["entity_type"], order)).where(F.col("_rank") <= offset + limit).where(F.col("_rank") > offset).drop("_rank")


def page_after(df: DataFrame, after: dict | None = None, limit: int = MAX_ROWS, order: tuple[str, ...] = ("time_index", "entity_id", "instance_id")) -> DataFrame:
    """The next rows after a row, by the columns of ``order``: paging whose cost doesn't grow with the depth.

    ``after`` has the values of these columns in the last row of the page before; none starts at the front. Together
    the columns must tell rows apart, or rows equal to the last one of a page would be passed over."""
    if after is not None:
        found = F.lit(False)
        for column in reversed(order):
            found = (F.col(column) > F.lit(after[column])) | ((F.col(column) == F.lit(after[column])) & found)
        # the first column alone bounds the scan
        df = df.where((F.col(order[0]) >= F.lit(after[order[0]])) & found)
    return df.orderBy(*order).limit(limit)


def last_value(df: DataFrame, attrs: list[str], ties: bool = False, tie: tuple[str, ...] = ()) -> DataFrame:
    """The newest row of each entity: one (the largest of ``tie`` and the attributes among rows of one time), or with ties=True all of them."""
    columns = [*KEY, "time_index", *unique(attrs)]
    if ties:
        rank = F.rank().over(Window.partitionBy(*KEY).orderBy(F.desc("time_index")))
        return df.withColumn("_rank", rank).where("_rank = 1").select(*columns)
    rest = [c for c in columns if c not in (*KEY, "time_index")]
    newest = F.max(F.struct("time_index", *tie, *[c for c in rest if c not in tie]))
    found = df.groupBy(*KEY).agg(newest.alias("_new"))
    return found.select(*KEY, *[F.col(f"_new.{c}").alias(c) for c in ["time_index", *rest]])


def last_value_join(df: DataFrame, attrs: list[str]) -> DataFrame:
    """The same with ties, as a join of the table with each entity's latest time."""
    newest = df.groupBy(*KEY).agg(F.max("time_index").alias("time_index"))
    return df.join(newest, [*KEY, "time_index"]).select(*KEY, "time_index", *unique(attrs))


def query_batch_entities(df: DataFrame, requests: DataFrame, attrs: list[str], tie: tuple[str, ...] = ()) -> DataFrame:
    """The last value of each requested (entity_type, entity_id), in one job for all requests."""
    return last_value(df.join(requests.select(*KEY).distinct(), list(KEY), "left_semi"), attrs, tie=tie)


def list_entities(df: DataFrame, limit: int = MAX_ROWS, offset: int = 0) -> DataFrame:
    """Every entity with its latest time, the newest first."""
    found = df.groupBy(*KEY).agg(F.max("time_index").alias("time_index"))
    return found.orderBy(F.desc("time_index"), *KEY).offset(offset).limit(limit)


def list_entity_types(df: DataFrame) -> DataFrame:
    return df.select("entity_type").distinct()


def list_instance_ids(df: DataFrame, limit: int = MAX_ROWS) -> DataFrame:
    return df.select("instance_id").orderBy("instance_id").limit(limit)


def count_failed_batches(df: DataFrame) -> DataFrame:
    """Rejected rows of each failed batch."""
    return df.where("failed_batch_id is not null").groupBy("failed_batch_id").count().withColumnRenamed("count", "n")


def union_types(tables: list[DataFrame]) -> DataFrame:
    """The rows of several tables; attributes that a table lacks are NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def multi_type_history(df: DataFrame, attrs: list[str], limit: int = MAX_ROWS, offset: int = 0) -> DataFrame:
    """A page of each type's history, types and ids in order."""
    return paginate(df, limit, offset).select(*KEY, "time_index", *unique(attrs)).orderBy(*KEY, "time_index")


def merge_observations(tables: list[DataFrame]) -> DataFrame:
    """Telemetry of several stores together."""
    return union_types(tables)


def _matches(entity_type=None, ids=None, pattern=None, from_=None, to=None, path=None) -> Column:
    from .filters import _bound

    tests = [F.lit(True)]
    if entity_type:
        tests.append(F.lower("entity_type") == entity_type.lower())
    if ids is not None:
        tests.append(F.col("entity_id").isin(list(ids)))
    if pattern:
        tests.append(F.col("entity_id").rlike(f"(?i){pattern}"))
    if from_ is not None:
        tests.append(F.col("time_index") >= _bound(from_))
    if to is not None:
        tests.append(F.col("time_index") <= _bound(to))
    if path and path != "/":
        low = F.lower(F.coalesce("fiware_servicepath", F.lit("")))
        tests.append((low == path.lower()) | low.startswith(path.lower() + "/"))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def delete_entities(df: DataFrame, **which) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go) for any of entity_type, ids, pattern, from_, to, path. A row for which a
    test is unknown stays."""
    gone = _matches(**which)
    return df.where(~gone), df.where(gone)


def delete_entity(df: DataFrame, entity_id: str, entity_type: str | None = None, from_=None, to=None) -> tuple[DataFrame, DataFrame]:
    """The same for one entity; its type is looked up where it is not given."""
    from .filters import single_entity_type

    return delete_entities(df, entity_type=entity_type or single_entity_type(df, entity_id), ids=[entity_id], from_=from_, to=to)


def drop_type(df: DataFrame, entity_type: str, path: str = "/") -> DataFrame:
    """All rows but those of a type; only for the root path."""
    if path != "/":
        raise ValueError("a type can be dropped for the root path only")
    return df.where(F.lower("entity_type") != entity_type.lower())
