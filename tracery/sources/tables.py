"""Series tables, catalogs, dead letters, CSV loads and copies between stores."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ingest import parse_bodies


def read_notifications(spark: SparkSession, path: str, wholetext: bool = False) -> DataFrame:
    """Entities of notification bodies in text files, one body a line or with wholetext one a file."""
    return parse_bodies(spark.read.text(path, wholetext=wholetext).withColumnRenamed("value", "body"))


def write_series(rows: DataFrame, path: str, files: int = 16) -> None:
    """Append rows to the table of their tenant, type and date, sorted by entity and time. A busy type spreads
    over ``files`` writers by its ids."""
    dated = rows.withColumn("date", F.to_date("time_index"))
    parts = ["tenant", "entity_type", "date"]
    dealt = dated.repartition(*parts, F.pmod(F.xxhash64("entity_id"), F.lit(files)))
    dealt.sortWithinPartitions(*parts, "entity_id", "time_index").write.mode("append").partitionBy(*parts).parquet(path)


def read_series(spark: SparkSession, path: str, tenant: str | None = None, entity_type: str | None = None, schema: str | StructType | None = None) -> DataFrame:
    """The table, pruned to a tenant's and a type's partitions; columns that were added later are NULL before.

    With a ``schema`` (from the catalog, partition columns included) no file is opened to find the columns; without one the
    footers of all files are read."""
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", True)
    df = reader.parquet(path)
    if tenant:
        df = df.where(F.col("tenant") == tenant.lower())
    return df.where(F.col("entity_type") == entity_type) if entity_type else df


def dead_letter_sink(rejected: DataFrame, path: str) -> None:
    rejected.write.mode("append").parquet(path)


def load_csv_series(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with a header, quoted by ', and the table that each file's name stands for."""
    df = spark.read.csv(path, header=True, quote="'", escape="'", schema=schema)
    return df.withColumn("table_name", F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.csv)?$", 1))


def read_telemetry(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """Telemetry CSV files (nanoseconds, measurement, label, process) by the prefix of their names."""
    raw = spark.read.csv(f"{folder}/{prefix}*.csv", header=True, schema="Timepoint long, Measurement double, Label string, PID int")
    return raw.select(F.expr("timestamp_micros(Timepoint div 1000)").alias("time"), F.col("Measurement").alias("measurement"), F.col("Label").alias("label"), F.col("PID").alias("pid"))


def convert_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast by a map of column to type; the others stay; a value that doesn't fit is NULL."""
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def migrate_store(df: DataFrame, types: dict[str, str], path: str, where: Column | str | None = None, mode: str = "append") -> DataFrame:
    """Copy a table, or the rows of it that a predicate holds for, to another store with a map of types."""
    moved = convert_types(df if where is None else df.where(where), types)
    moved.write.mode(mode).parquet(path)
    return moved


def _delete_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def finish_rewrite(spark: SparkSession, path: str, parts: tuple[str, ...] = ("tenant", "entity_type", "date")) -> bool:
    """Put a prepared rewrite in place, and say whether there was one. It may be run again after a crash at any point: what
    is prepared stays until all of it is in place. A rewrite that was not prepared to its end is thrown away."""
    beside = f"{path.rstrip('/')}-rewrite"
    ready = _exists(spark, f"{beside}/ready/_SUCCESS")
    if ready:
        rows = spark.read.parquet(f"{beside}/rows")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
        # partitions without any row left: a folder each
        for row in spark.read.parquet(f"{beside}/ready").toLocalIterator():
            names = [spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(k, row[k]) for k in parts]
            _delete_folder(spark, "/".join([path.rstrip("/"), *names]))
    if _exists(spark, beside):
        _delete_folder(spark, beside)
    return ready


def rewrite_partitions(spark: SparkSession, path: str, gone: Column, parts: tuple[str, ...] = ("tenant", "entity_type", "date")) -> int:
    """Delete rows from a stored table and return how many: only the partitions that hold some are written again.

    The rows that stay are written beside the table first, then the list of partitions that end up empty, then both are put in
    place; a run that was lost on the way is finished, or undone if it had not got that far, by the next one."""
    finish_rewrite(spark, path, parts)
    df = spark.read.parquet(path)
    hit = df.where(gone)
    count = hit.count()
    if count:
        beside = f"{path.rstrip('/')}-rewrite"
        touched = hit.select(*parts).distinct()
        same = lambda a, b: reduce(and_, [a[k].eqNullSafe(b[k]) for k in parts])  # noqa: E731  a tenant may be NULL
        kept = df.join(touched, same(df, touched), "left_semi").where(~F.coalesce(gone, F.lit(False)))
        kept.select(*[c for c in df.columns if c not in parts], *parts).write.mode("overwrite").parquet(f"{beside}/rows")
        left = spark.read.schema(df.select(*[c for c in df.columns if c not in parts], *parts).schema).parquet(f"{beside}/rows").select(*parts).distinct()
        touched.join(left, same(touched, left), "left_anti").select(*[F.col(k).cast("string") for k in parts]).write.mode("overwrite").parquet(f"{beside}/ready")
        finish_rewrite(spark, path, parts)
    return count
