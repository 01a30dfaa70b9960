"""Filters over series tables: ids, times, service paths, types, tenants and free predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import PERIODS

METHODS = ("count", "sum", "avg", "min", "max")
#: Ids at most that become a literal list; longer lists are joined.
LITERAL_IDS = 200


def filter_entity_ids(df: DataFrame, ids) -> DataFrame:
    """Rows of the given ids: a list, or a DataFrame with entity_id of any size."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
    ids = list(ids)
    if len(ids) <= LITERAL_IDS:
        return df.where(F.col("entity_id").isin(ids))
    return df.join(df.sparkSession.createDataFrame([(i,) for i in ids], "entity_id string").distinct(), "entity_id", "left_semi")


def _bound(value) -> Column:
    if isinstance(value, str):
        from ..functions.times import parse_date

        text = value.strip().strip("\"'")
        if not re.match(r"^\d{4}-?\d{2}-?\d{2}([T ].*)?$", text):
            raise ValueError(f"not an ISO-8601 time: {value!r}")
        return parse_date(F.lit(text))
    return F.lit(value)


def filter_time_range(df: DataFrame, from_=None, to=None) -> DataFrame:
    """Rows from one time to another, both included; either may be left out. A bad time is an error. A stored table, which
    has the ``date`` of each row as a partition, is read for those dates only."""
    for value, after in ((from_, True), (to, False)):
        if value is not None:
            bound = _bound(value)
            df = df.where(F.col("time_index") >= bound if after else F.col("time_index") <= bound)
            if "date" in df.columns:
                df = df.where(F.col("date") >= F.to_date(bound) if after else F.col("date") <= F.to_date(bound))
    return df


def filter_service_path(df: DataFrame, path: str | None) -> DataFrame:
    """Rows of a path and all below it, in any case; / is any path, an empty path matches rows without one."""
    column = F.coalesce("fiware_servicepath", F.lit(""))
    if path is None or path == "/":
        return df
    if path == "":
        return df.where(column == "")
    low = F.lower(column)
    return df.where((low == path.lower()) | low.startswith(path.lower() + "/"))


def filter_id_pattern(df: DataFrame, pattern: str) -> DataFrame:
    """Rows whose id has a match of a regular expression anywhere, in any case."""
    return df.where(F.col("entity_id").rlike(f"(?i){pattern}"))


def filter_entity_type(df: DataFrame, types: str | None) -> DataFrame:
    """Rows of one type or of a list such as a,b, in any case; None is all types."""
    return df if not types else df.where(F.lower("entity_type").isin([t.strip().lower() for t in types.split(",")]))


def filter_tenant(df: DataFrame, tenant: str | None) -> DataFrame:
    """Rows of a tenant; None is rows without one."""
    return df.where(F.col("tenant").isNull()) if not tenant else df.where(F.col("tenant") == tenant.lower())


def filter_attribute(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which any predicate on attributes holds."""
    return df.where(predicate)


def resolve_entity_type(df: DataFrame, entity_id: str) -> DataFrame:
    """The types that own an id."""
    return df.where(F.col("entity_id") == entity_id).select("entity_type").distinct()


def single_entity_type(df: DataFrame, entity_id: str) -> str | None:
    """The type that owns an id; more than one is an error, none is None."""
    found = [r[0] for r in resolve_entity_type(df, entity_id).limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"{entity_id} has several types; name one")
    return found[0] if found else None


def validate_query_params(attrs: list[str] | None = None, method: str | None = None, period: str | None = None, options: str | None = None) -> None:
    """A period needs a method, a method needs attributes, both come from fixed lists; options are refused."""
    if options:
        raise ValueError("options are not supported")
    if method and method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method and not attrs:
        raise ValueError("a method needs attributes")
    if period and not method:
        raise ValueError("a period needs a method")
    if period and period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}")
