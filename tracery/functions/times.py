"""Times: ISO text, lenient parsing, periods and the choice of an update's timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("year", "month", "day", "hour", "minute", "second")

_ISO = r"^\d{4}(-\d{2}(-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?)?)?$"
_BASIC = r"^\d{8}T\d{6}(Z)?$"


def _bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "^[\"']|[\"']$", ""))


def _iso_time(t: Column) -> Column:
    iso = F.when(t.rlike(_ISO), F.try_to_timestamp(F.regexp_replace(t, ",", ".")))
    return F.coalesce(iso, F.when(t.rlike(_BASIC), F.try_to_timestamp(F.regexp_replace(t, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss"))))


def parse_date(text: Column) -> Column:
    """Strict ISO-8601 text, quotes around it dropped, as a timestamp; anything else is NULL. No zone means UTC."""
    return _iso_time(_bare(text))


def _loose(text: Column, once) -> Column:
    forms = ("yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "dd MMM yyyy HH:mm:ss", "dd MMM yyyy")
    plain = F.regexp_replace(F.trim(text), r"^[A-Z][a-z]{2}, (.*?)(?: GMT| UTC)?$", "$1")
    return once(plain, lambda t: F.coalesce(once(_bare(t), _iso_time), *[F.try_to_timestamp(t, F.lit(f)) for f in forms]))


def parse_time_loose(text: Column) -> Column:
    """ISO text or a few other common forms; the first that parses wins, none gives NULL."""
    return _loose(text, lambda value, body: body(value))


def latest_time(texts: Column) -> Column:
    """The most recent time of an array of texts; unparsable ones are passed over."""
    return F.array_max(F.transform(texts, parse_time_loose))


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 in UTC with milliseconds and +00:00; NULL becomes the text NULL. The session's zone is UTC."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSxxx"), F.lit("NULL"))


def period_start(period: str, ts: Column) -> Column:
    """The start of the calendar period that holds a time."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}, not {period!r}")
    return F.date_trunc(period, ts)


def table_name(tenant: Column, entity_type: Column) -> Column:
    """mt<tenant>.et<type> in lower case; without a tenant only the type's part."""
    own = F.concat(F.lit("et"), F.lower(entity_type))
    return F.when(F.coalesce(tenant, F.lit("")) == "", own).otherwise(F.concat(F.lit("mt"), F.lower(tenant), F.lit("."), own))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _attr_time(attrs: Column, name: str) -> Column:
    def read(a: Column) -> Column:
        plain = F.try_variant_get(a, "$", "string")
        return F.coalesce(F.try_variant_get(a, "$.value", "string"), F.try_variant_get(a, "$.value['@value']", "string"), plain)

    return _loose(_let(F.element_at(attrs, F.lit(name)), read), _let)


def _latest_in(attrs: Column, path: str) -> Column:
    texts = F.filter(F.transform(F.map_values(attrs), lambda a: F.try_variant_get(a, path, "string")), lambda t: t.isNotNull())
    return F.array_max(F.transform(texts, lambda t: _loose(t, _let)))


def select_time_index(attrs: Column, custom: str | None = None, default: Column | None = None) -> Column:
    """The time of an update, by the first of these that parses: the custom attribute, the latest custom metadata,
    then the same for TimeInstant and timestamp, the latest observedAt and modifiedAt of any attribute, those two
    of the entity, the attribute dateModified, the latest dateModified metadata; else ``default`` or now.

    ``attrs`` is a map of name to attribute (VARIANT)."""
    found = []
    for name in ([custom] if custom else []) + ["TimeInstant", "timestamp"]:
        found += [_attr_time(attrs, name), _latest_in(attrs, f"$.metadata.{name}.value")]
    found += [_latest_in(attrs, "$.observedAt"), _latest_in(attrs, "$.modifiedAt")]
    found += [_attr_time(attrs, "observedAt"), _attr_time(attrs, "modifiedAt"), _attr_time(attrs, "dateModified")]
    found.append(_latest_in(attrs, "$.metadata.dateModified.value"))
    return F.coalesce(*found, default if default is not None else F.current_timestamp())
