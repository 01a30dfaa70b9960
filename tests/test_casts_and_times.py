import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracery.functions import casts, times

VALUES = ["true", "1", "1.1", '"1.1"', '"false"', '{"a": 1}', '["x", 2]', '"2018-01-05T15:44:34"', '{"@type": "DateTime", "@value": "2018-01-05T15:44:34Z"}', "null", '""']
WHEN = dt.datetime(2018, 1, 5, 15, 44, 34)


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame(list(enumerate(VALUES)), "i int, j string").select("i", F.try_parse_json("j").alias("v")).coalesce(1)


def run(values, column):
    return [r[1] for r in sorted(values.select("i", column.alias("x")).collect())]


@pytest.mark.parametrize(
    ("cast", "expected"),
    [
        (casts.cast_number, [None, 1.0, 1.1, 1.1, None, None, None, None, None, None, None]),
        (casts.cast_integer, [None, 1, 1, 1, None, None, None, None, None, None, None]),
        (casts.cast_boolean, [True, True, None, None, False, None, None, None, None, None, None]),
        (casts.cast_datetime, [None] * 7 + [WHEN] + [None] * 3),
        (casts.cast_ld_datetime, [None] * 8 + [WHEN] + [None] * 2),
        (casts.cast_array, [None] * 6 + [["x", "2"]] + [None] * 4),
        (casts.cast_text, ["True", "1", "1.1", "1.1", "false", "{'a': 1}", "['x', 2]", "2018-01-05T15:44:34", "{'@type': 'DateTime', '@value': '2018-01-05T15:44:34Z'}", None, ""]),
        (casts.infer_value_type, ["Boolean", "Integer", "Number", "Text", "Text", "StructuredValue", "Array", "DateTime", "DateTime", "Text", "Text"]),
    ],
)
def test_casts(values, cast, expected):
    assert run(values, cast(F.col("v"))) == expected


def test_declared_type_wins_unless_property(spark):
    rows = [('{"type": "Custom", "value": 1}',), ('{"type": "Property", "value": 1}',), ('{"value": true}',)]
    df = spark.createDataFrame(rows, "j string").select(casts.infer_attr_type(F.try_parse_json("j")).alias("t"))
    assert [r[0] for r in df.collect()] == ["Custom", "Integer", "Boolean"]


def test_relationship(spark):
    df = spark.createDataFrame([('{"object": "o"}',), ('{"value": "v", "object": "o"}',), ("{}",)], "j string")
    assert [r[0] for r in df.select(casts.cast_relationship(F.try_parse_json("j"))).collect()] == ["o", "v", None]


def test_strict_dates(spark):
    texts = ["2018-01-05", "'2018-01-05T15:44:34Z'", "20180105T154434", "now", "12:30:00", "bad", None, "2018-01-05T15:44:34+02:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(times.parse_date(F.col("t")))
    assert [r[0] for r in df.collect()] == [dt.datetime(2018, 1, 5), WHEN, WHEN, None, None, None, None, WHEN - dt.timedelta(hours=2)]


def test_loose_dates(spark):
    df = spark.createDataFrame([("10 Jan 2020",), ("Fri, 10 Jan 2020 01:02:03 GMT",), ("2020/01/10",), ("x",)], "t string")
    found = [r[0] for r in df.select(times.parse_time_loose(F.col("t"))).collect()]
    assert found == [dt.datetime(2020, 1, 10), dt.datetime(2020, 1, 10, 1, 2, 3), dt.datetime(2020, 1, 10), None]


SLOTS = [
    ("custom attribute", '"mine": {"value": "2020-01-01T00:00:00"}'), ("custom metadata", '"a": {"value": 1, "metadata": {"mine": {"value": "2020-01-02T00:00:00"}}}'),
    ("TimeInstant", '"TimeInstant": {"value": "2020-01-03T00:00:00"}'), ("TimeInstant metadata", '"b": {"value": 1, "metadata": {"TimeInstant": {"value": "2020-01-04T00:00:00"}}}'),
    ("timestamp", '"timestamp": {"value": "2020-01-05T00:00:00"}'), ("timestamp metadata", '"c": {"value": 1, "metadata": {"timestamp": {"value": "2020-01-06T00:00:00"}}}'),
    ("observedAt of attributes", '"d": {"value": 1, "observedAt": "2020-01-07T00:00:00"}'), ("modifiedAt of attributes", '"e": {"value": 1, "modifiedAt": "2020-01-08T00:00:00"}'),
    ("observedAt", '"observedAt": "2020-01-09T00:00:00"'), ("modifiedAt", '"modifiedAt": "2020-01-10T00:00:00"'),
    ("dateModified", '"dateModified": {"value": "2020-01-11T00:00:00"}'), ("dateModified metadata", '"f": {"value": 1, "metadata": {"dateModified": {"value": "2020-01-12T00:00:00"}}}'),
]


def test_time_index_order(spark):
    rows = [(k, "{" + ", ".join(s for _, s in SLOTS[k:]) + "}") for k in range(len(SLOTS))]
    df = spark.createDataFrame(rows, "k int, j string").select("k", F.try_variant_get(F.try_parse_json("j"), "$", "map<string,variant>").alias("m"))
    found = dict(df.select("k", times.select_time_index(F.col("m"), "mine").alias("t")).collect())
    assert found == {k: dt.datetime(2020, 1, k + 1) for k in range(len(SLOTS))}


def test_time_index_default(spark):
    df = spark.createDataFrame([("{}",)], "j string").select(F.try_variant_get(F.try_parse_json("j"), "$", "map<string,variant>").alias("m"))
    found = df.select(times.select_time_index(F.col("m"), default=F.lit("2000-01-01").cast("timestamp"))).first()[0]
    assert found == dt.datetime(2000, 1, 1)
    assert df.select(times.iso_timestamp(F.lit(None).cast("timestamp"))).first()[0] == "NULL"
