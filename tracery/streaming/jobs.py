"""Continuous forms: ingest with dead letters, period aggregates and last values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.times import period_start
from ..operators.ingest import parse_bodies
from ..operators.query import KEY
from ..sources import store

_DELAY = "spark.watermarkDelayMs"
#: Entities are dealt to so many keys of the state; the number is fixed for a checkpoint.
BUCKETS = 1024
_WIDTHS = {"second": "1 second", "minute": "1 minute", "hour": "1 hour", "day": "1 day"}


def stream_notifications(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Entities of notification bodies that arrive as text files, one body a line."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return parse_bodies(lines.withColumnRenamed("value", "body"))


def stream_ingest(spark: SparkSession, source: str, path: str, checkpoint: str, name: str = "bodies", custom: str | None = None) -> StreamingQuery:
    """Bodies that arrive as text files, one a line, into a store (``sources.store``): each batch is one commit of typed rows by
    entity type, new columns, rejected entities and refused bodies. A batch that runs again after a crash, at whatever point, is
    committed once; nothing that arrives is lost without a row that says why."""
    lines = spark.readStream.text(source).withColumnRenamed("value", "body")

    def write(batch: DataFrame, batch_id: int) -> None:
        store.ingest_bodies(batch.sparkSession, path, batch, name, batch_id, custom)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dead_letter(rejected: DataFrame, path: str, batch_id: int) -> None:
    """A batch's rejected rows, under its id."""
    rejected.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def stream_period_aggregate(rows: DataFrame, attr: str, period: str, late: str = "1 day") -> DataFrame:
    """count, sum, min and max of an attribute by entity and period of a stream, as updates. The watermark closes periods at their
    ends: the first batch that begins after that drops their state, and later ones take no rows of theirs. Seconds to days are windows of Spark; months and years,
    which have no fixed length, are structs of start and end that carry the watermark as a window does."""
    marked = rows.withWatermark("time_index", late)
    values = [F.count(attr).alias("n"), F.sum(attr).alias("total"), F.min(attr).alias("least"), F.max(attr).alias("most")]
    if period in _WIDTHS:
        found = marked.groupBy(F.window("time_index", _WIDTHS[period]), *KEY).agg(*values)
        return found.select(*KEY, F.col("window.start").alias("time_index"), "n", "total", "least", "most")
    start = period_start(period, F.col("time_index"))
    end = start + F.make_ym_interval(F.lit(int(period == "year")), F.lit(int(period == "month")))
    # Spark finds a key's end in its second field where the key has the delay of the watermark; it makes windows in the same way
    whole = F.struct(start.alias("start"), end.alias("end")).alias("_period", metadata={_DELAY: marked.schema["time_index"].metadata[_DELAY]})
    found = marked.where("time_index is not null").select(*KEY, whole, attr).groupBy("_period", *KEY).agg(*values)
    return found.select(*KEY, F.col("_period.start").alias("time_index"), "n", "total", "least", "most")


def needs_keyed_state(spark: SparkSession) -> None:
    """Set the state store that keyed state with timers needs, for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Newest(StatefulProcessor):
    """The newest row of each entity of a bucket; one that has been idle for long leaves the state. A bucket's entities come in one
    call, as a call costs milliseconds; each is a row of the state of its own, read and written only if it has updates."""

    def __init__(self, key: T.StructType, schema: T.StructType, idle_ms: int) -> None:
        self.key, self.schema, self.idle_ms = key, schema, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.newest = handle, handle.getMapState("newest", self.key, self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [*KEY, *self.schema.names]
        best: dict[tuple, tuple] = {}
        for batch in rows:
            own = batch[names]
            own = own[own["time_index"] == own.groupby(list(KEY), dropna=False)["time_index"].transform("max")]
            for row in own.astype(object).where(own.notna(), None).itertuples(index=False, name=None):
                entity, row = row[: len(KEY)], (row[len(KEY)].to_pydatetime(), *row[len(KEY) + 1 :])
                if entity not in best or _order(row) > _order(best[entity]):
                    best[entity] = row
        held = self.newest.exists()
        changed = []
        for entity, row in best.items():
            kept = self.newest.getValue(entity) if held else None
            if kept is None or _order(row) > _order(tuple(kept)):
                self.newest.updateValue(entity, row)
                changed.append((*entity, *row))
        for at in {self._looks(row[len(KEY)]) for row in changed}:
            self.handle.registerTimer(at)
        if changed:
            yield pd.DataFrame(changed, columns=names, dtype=object)

    def _leaves(self, last) -> int:
        return int(last.timestamp() * 1000) + self.idle_ms

    def _looks(self, last) -> int:
        """When a bucket is looked through for an entity: not for each of its own, so up to a 32nd of ``idle`` later."""
        step = max(self.idle_ms // 32, 1)
        return -(-self._leaves(last) // step) * step

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for entity in [tuple(entity) for entity, row in self.newest.iterator() if self._leaves(row[0]) <= now]:
            self.newest.removeKey(entity)
        yield from ()

    def close(self) -> None:
        pass


def _order(row: tuple) -> tuple:
    """Time first, then the attributes with NULLs first, as Spark orders structs."""
    return tuple((v is not None, v) if v is not None else (False, 0) for v in row)


def merge_last(current: DataFrame, batch: DataFrame, attrs: list[str]) -> DataFrame:
    """Last values after a batch: a late row never replaces a newer one."""
    newest = F.max(F.struct("time_index", *attrs)).alias("_new")
    found = current.select(*KEY, "time_index", *attrs).unionByName(batch.select(*KEY, "time_index", *attrs)).groupBy(*KEY).agg(newest)
    return found.select(*KEY, *[F.col(f"_new.{c}").alias(c) for c in ("time_index", *attrs)])


def stream_last_value(rows: DataFrame, attrs: list[str], path: str, checkpoint: str, idle: str = "30 days", late: str = "1 day") -> StreamingQuery:
    """Keep the last value of each entity of a stream: one row an entity in keyed state, where late rows lose; a batch writes the
    entities that changed only, under its id, so one that runs again replaces its own. An entity without updates for ``idle``
    (and the watermark's ``late``, and a little) leaves the state, not the table; a row that comes after that is written again, and
    ``read_last_value`` still takes the newest. The session needs the RocksDB state store (``needs_keyed_state``)."""
    marked = rows.select(*KEY, "time_index", *attrs).withWatermark("time_index", late)
    state = T.StructType([rows.schema[c] for c in ("time_index", *attrs)])
    key = T.StructType([rows.schema[k] for k in KEY])
    dealt = marked.withColumn("_bucket", F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)))
    found = dealt.groupBy("_bucket").transformWithStateInPandas(_Newest(key, state, _milliseconds(idle)), T.StructType([*key, *state]), "Update", "EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _milliseconds(width: str) -> int:
    number, unit = width.split()
    return int(float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000)


def read_last_value(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each entity in all that the batches wrote."""
    all_ = spark.read.parquet(path).drop("batch")
    rest = [c for c in all_.columns if c not in KEY]
    return all_.groupBy(*KEY).agg(F.max(F.struct(*rest)).alias("_new")).select(*KEY, *[F.col(f"_new.{c}").alias(c) for c in rest])


def compact_last_value(spark: SparkSession, path: str, to: str) -> None:
    """The same rows as one batch of another folder, for when many batches have come together."""
    read_last_value(spark, path).write.mode("overwrite").parquet(f"{to}/batch=-1")
