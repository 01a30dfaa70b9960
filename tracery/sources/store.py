"""A store of entity series: typed tables, catalog, dead letters and refused bodies under one versioned manifest.

Everything is written to folders of its own first; a commit then adds one small file, the next version of the manifest,
which names the folders that count. The file is made only if no one else has made that version; a writer who comes second
reads the new version and tries again. So a commit over several tables shows as a whole or not at all, readers stay on the
version that they began with, and what a lost writer left behind is never read."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from ..operators import ingest as steps

#: Columns that every table has; an attribute of such a name is stored as attr_<name>.
FIXED = {"tenant": "string", "entity_type": "string", "entity_id": "string", "fiware_servicepath": "string", "time_index": "timestamp", "date": "date"}
CATALOG = "entity_type string, column string, attr_name string, ngsi_type string, column_type string, since long"
DEAD = "entity_type string, entity_id string, raw_entity string, failed_batch_id string, error string"
REFUSED = "body string, refusal string, failed_batch_id string"
_BITMAPS = "file string, bucket long, bits binary"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, folder: str) -> list:
    p, fs = _path(spark, folder)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with all of its text at once, and say whether that worked; False where it is there already.

    The text is written beside it and then moved without overwriting, or hard-linked on a local file system: either is one step."""
    folder, _, name = path.rpartition("/")
    beside, fs = _path(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    target, _ = _path(spark, path)
    try:
        if fs.getScheme() == "file":
            os.link(beside.toUri().getPath(), target.toUri().getPath())
        else:
            options = spark._jvm.org.apache.hadoop.fs.Options.Rename
            none = spark.sparkContext._gateway.new_array(options, 1)
            none[0] = options.NONE
            spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(beside, target, none)
    except FileExistsError:
        return False
    except (Py4JJavaError, CapturedException):
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(beside, False)
    return True


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of the manifest that are there, in order."""
    names = [f.getPath().getName() for f in _children(spark, f"{path}/manifest")]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """One version of the manifest, the newest by default; an empty one before the first commit."""
    found = versions(spark, path)
    if version is None and not found:
        return {"version": 0, "tables": {}, "catalog": [], "dead": [], "refused": [], "streams": {}}
    p, fs = _path(spark, f"{path}/manifest/{(found[-1] if version is None else version):020d}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, change: Callable[[dict], dict | None], attempts: int = 50) -> dict:
    """Put the next version in place: ``change`` gets the newest one and returns the next, or None if there is nothing to do.
    It is called again with the version of whoever came first."""
    for _ in range(attempts):
        new = change(snapshot(spark, path))
        if new is None:
            return snapshot(spark, path)
        new["version"] += 1
        if put_if_absent(spark, f"{path}/manifest/{new['version']:020d}.json", json.dumps(new)):
            return new
    raise RuntimeError(f"{attempts} other commits to {path} came first")


def _read(spark: SparkSession, schema: str, base: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/_commit={c}" for c in folders])


def read_catalog(spark: SparkSession, path: str, state: dict | None = None) -> DataFrame:
    """(entity_type, column, attr_name, ngsi_type, column_type, since): the columns of all tables. The type that a column had
    first stays; ``since`` is the version that added it."""
    state = state or snapshot(spark, path)
    return _read(spark, CATALOG, f"{path}/catalog", state["catalog"]).drop("_commit")


def read_dead_letters(spark: SparkSession, path: str, state: dict | None = None) -> DataFrame:
    """Entities that were rejected, and why."""
    return _read(spark, DEAD, f"{path}/dead", (state or snapshot(spark, path))["dead"]).drop("_commit")


def read_refused(spark: SparkSession, path: str, state: dict | None = None) -> DataFrame:
    """Bodies that were refused as a whole, and why."""
    return _read(spark, REFUSED, f"{path}/refused", (state or snapshot(spark, path))["refused"]).drop("_commit")


def _columns(catalog: DataFrame, entity_type: str) -> list:
    """A type's columns on the driver: as many rows as it has attributes."""
    return catalog.where(F.col("entity_type") == entity_type).orderBy("column").collect()


def _stored_name(column: str) -> str:
    return f"attr_{column}" if column in FIXED or column.startswith("_") else column


def _base(path: str, kind: str, entity_type: str) -> str:
    return f"{path}/{kind}/{quote(entity_type, safe='')}"


def _located(spark: SparkSession, path: str, entity_type: str, state: dict) -> DataFrame:
    """A table's rows that are not deleted, each with the file that holds it and its place there."""
    columns = [(_stored_name(r["column"]), r["column_type"]) for r in _columns(read_catalog(spark, path, state), entity_type)]
    own = state["tables"].get(entity_type, {"data": [], "deletes": []})
    names = ", ".join(f"`{c}` {t}" for c, t in [("entity_id", "string"), ("fiware_servicepath", "string"), ("time_index", "timestamp"), *columns])
    base = _base(path, "data", entity_type)
    rows = _read(spark, f"{names}, _tenant string, _date date", base, own["data"])
    # files are named from the table's folder on, so that a store may be moved
    place = [_relative(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_at")] if own["data"] else [F.lit("").alias("_file"), F.lit(0).cast("long").alias("_at")]
    rows = rows.select(
        F.col("_tenant").alias("tenant"), F.lit(entity_type).alias("entity_type"), "entity_id", "fiware_servicepath", "time_index", F.col("_date").alias("date"), *[c for c, _ in columns], *place,
    )
    if not own["deletes"]:
        return rows
    gone = _read(spark, _BITMAPS, _base(path, "deletes", entity_type), own["deletes"]).groupBy("file", "bucket").agg(F.bitmap_or_agg("bits").alias("_bits"))
    marked = rows.join(gone, (rows["_file"] == gone["file"]) & (F.bitmap_bucket_number(rows["_at"]) == gone["bucket"]), "left")
    bit = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (bit % 8).cast("int")) == 1
    return marked.where(F.col("_bits").isNull() | ~hit).select(*rows.columns)


def _relative(file: Column) -> Column:
    return F.concat(F.lit("_commit="), F.substring_index(file, "/_commit=", -1))


def read_table(spark: SparkSession, path: str, entity_type: str, tenant: str | None = None, version: int | None = None) -> DataFrame:
    """A type's rows in one version of the store (the newest by default), with the columns of the catalog; no file is opened to
    find them. A tenant and tests of ``date`` prune folders. A type that is not there has no rows."""
    rows = _located(spark, path, entity_type, snapshot(spark, path, version)).drop("_file", "_at")
    return rows.where(F.col("tenant") == tenant.lower()) if tenant else rows


def entity_types(spark: SparkSession, path: str, version: int | None = None) -> list[str]:
    return sorted(snapshot(spark, path, version)["tables"])


def _write(rows: DataFrame, base: str, parts: tuple[str, ...] = ()) -> str:
    name = uuid.uuid4().hex
    rows.write.partitionBy(*parts).parquet(f"{base}/_commit={name}") if parts else rows.write.parquet(f"{base}/_commit={name}")
    return name


def _write_rows(rows: DataFrame, path: str, entity_type: str, files: int) -> str:
    """Rows with the fixed columns, by tenant and day; a busy day spreads over ``files`` writers by its ids."""
    dated = rows.withColumns({"_tenant": F.col("tenant"), "_date": F.to_date("time_index")}).drop("tenant", "entity_type", "date")
    dealt = dated.repartition("_tenant", "_date", F.pmod(F.xxhash64("entity_id"), F.lit(files)))
    return _write(dealt.sortWithinPartitions("_tenant", "_date", "entity_id", "time_index"), _base(path, "data", entity_type), ("_tenant", "_date"))


def _part(entity_type: Column) -> Column:
    """One of few folders for a type's staged rows."""
    return F.pmod(F.xxhash64(entity_type), F.lit(32)).cast("int")


def ingest_bodies(spark: SparkSession, path: str, bodies: DataFrame, stream: str | None = None, batch_id: int = 0, custom: str | None = None, files: int = 4) -> dict:
    """Commit a batch of notification bodies (``body``, and if there are such columns ``path_header`` and ``tenant``): typed rows
    by entity type, new columns of the catalog, rejected entities and refused bodies, all in one version.

    A batch of a ``stream`` that the manifest has already is left alone, so it may be run again after a crash at any point. If
    another writer came first, columns that it added keep its types, and this batch's rows are cast anew where that matters.
    What several passes read is staged in a folder of the store (not cached: rows of many attributes are wide) that goes at the end."""
    judged = steps.judge_bodies(bodies)
    batch = f"{stream or uuid.uuid4().hex}-{batch_id}"
    tenant = F.lower("tenant") if "tenant" in bodies.columns else F.lit(None).cast("string")
    found = steps.ingest(judged.where("refusal is null"), custom).withColumn("tenant", tenant)
    # an entity is kept whole only where it goes to the dead letters
    raw = F.when(F.col("error").isNotNull(), F.to_json("entity")).alias("raw_entity")
    found = found.select("position", "tenant", "entity_type", "entity_id", "fiware_servicepath", "time_index", "attrs", raw, "error", _part(F.col("entity_type")).alias("_part"))
    staged = f"{path}/staged/_commit={uuid.uuid4().hex}"
    rows_of: dict = {}

    def staged_rows() -> DataFrame:
        if not rows_of:
            found.write.partitionBy("_part").parquet(staged)
            # of no rows there are no files that tell the columns
            rows_of["all"] = spark.read.schema(found.schema).parquet(staged)
        return rows_of["all"]

    written: dict = {}

    def change(state: dict) -> dict | None:
        if stream is not None and state["streams"].get(stream, -1) >= batch_id:
            return None
        good, bad = steps.split_rejected(staged_rows(), batch)
        known = read_catalog(spark, path, state)
        if "columns" not in written:
            written["columns"] = steps.infer_schema(good).persist()
        new = steps.evolve_schema(known.drop("since"), written["columns"]).join(known, ["entity_type", "column"], "left_anti").withColumn("since", F.lit(state["version"] + 1).cast("long"))
        held = written["columns"].select("entity_type").distinct()
        # as many rows as the batch's types have attributes
        schemas: dict[str, list] = {}
        for r in known.unionByName(new).join(held, "entity_type", "left_semi").orderBy("entity_type", "column").collect():
            schemas.setdefault(r["entity_type"], []).append((r["column"], r["attr_name"], r["ngsi_type"]))
        if new.limit(1).count():
            state["catalog"].append(_write(new.coalesce(1), f"{path}/catalog"))
        keep = ("tenant", "entity_type", "entity_id", "fiware_servicepath", "time_index")
        for kind, schema in schemas.items():
            if written.get(kind, (None,))[0] != schema:
                rows = steps.pivot_attributes(good.where((F.col("_part") == _part(F.lit(kind))) & (F.col("entity_type") == kind)), schema, keep)
                rows = rows.toDF(*keep, *[_stored_name(c) for c, _, _ in schema])
                written[kind] = schema, _write_rows(rows, path, kind, files)
            state["tables"].setdefault(kind, {"data": [], "deletes": []})["data"].append(written[kind][1])
        for sink, rows in (("dead", bad), ("refused", judged.where("refusal is not null").select("body", "refusal", F.lit(batch).alias("failed_batch_id")))):
            if f"{sink} rows" not in written:
                written[f"{sink} rows"] = _write(rows, f"{path}/{sink}")
            state[sink].append(written[f"{sink} rows"])
        if stream is not None:
            state["streams"][stream] = batch_id
        return state

    try:
        return commit(spark, path, change)
    finally:
        p, fs = _path(spark, staged)
        fs.delete(p, True)
        if "columns" in written:
            written["columns"].unpersist()


def append_rows(spark: SparkSession, path: str, entity_type: str, rows: DataFrame, files: int = 4) -> dict:
    """Commit typed rows (entity_id, time_index, attributes; tenant and fiware_servicepath may be missing) of one type. Columns that the
    catalog has are cast to its types; a value that doesn't fit is NULL."""
    attrs = [c for c in rows.columns if c not in FIXED]
    full = rows.withColumns({c: F.lit(None).cast(t) for c, t in FIXED.items() if c not in rows.columns})
    written: dict = {}

    def change(state: dict) -> dict:
        known = read_catalog(spark, path, state)
        types = {r["column"]: r["column_type"] for r in _columns(known, entity_type)}
        new = [(entity_type, c.lower(), c, "Text", dict(rows.dtypes)[c], state["version"] + 1) for c in attrs if c.lower() not in types]
        if new:
            state["catalog"].append(_write(spark.createDataFrame(new, CATALOG).coalesce(1), f"{path}/catalog"))
        if written.get("types") != types:
            cast = [F.col(c).try_cast(types.get(c.lower(), dict(rows.dtypes)[c])).alias(_stored_name(c.lower())) for c in attrs]
            dated = full.select(F.lower("tenant").alias("tenant"), F.lit(entity_type).alias("entity_type"), "entity_id", "fiware_servicepath", "time_index", *cast)
            written.update(types=types, name=_write_rows(dated, path, entity_type, files))
        state["tables"].setdefault(entity_type, {"data": [], "deletes": []})["data"].append(written["name"])
        return state

    return commit(spark, path, change)


def delete_rows(spark: SparkSession, path: str, entity_type: str, gone: Column) -> int:
    """Delete the rows of a type for which ``gone`` is true, and say how many. No data file is written again: the commit adds a
    bitmap of positions for each file that holds some. A tenant of NULL and types of any letters are reached like all others."""
    found: dict = {"n": 0}

    def change(state: dict) -> dict | None:
        own = state["tables"].get(entity_type)
        if own is None:
            found["n"] = 0
            return None
        # rows that were added since are not meant; a table that was compacted or lost rows is looked at again
        if found.get("deletes") != own["deletes"] or not set(found["data"]) <= set(own["data"]):
            hit = _located(spark, path, entity_type, state).where(F.coalesce(gone, F.lit(False)))
            marks = hit.select(F.col("_file").alias("file"), F.bitmap_bucket_number("_at").alias("bucket"), F.bitmap_bit_position("_at").alias("bit"))
            name = _write(marks.groupBy("file", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), _base(path, "deletes", entity_type))
            n = _read(spark, _BITMAPS, _base(path, "deletes", entity_type), [name]).agg(F.sum(F.bitmap_count("bits"))).first()[0] or 0
            found.update(data=list(own["data"]), deletes=list(own["deletes"]), name=name, n=n)
        if not found["n"]:
            return None
        own["deletes"].append(found["name"])
        return state

    commit(spark, path, change)
    return found["n"]


def drop_table(spark: SparkSession, path: str, entity_type: str) -> bool:
    """Take a type's rows out of the store, and say whether there were any. Its columns stay in the catalog."""

    def change(state: dict) -> dict | None:
        return state if state["tables"].pop(entity_type, None) else None

    before = snapshot(spark, path)["version"]
    return commit(spark, path, change)["version"] > before


def compact(spark: SparkSession, path: str, entity_type: str, files: int = 4) -> bool:
    """Write a type's rows again without the deleted ones, in files of a few, and say whether there was anything to do. Older
    versions keep their files until ``vacuum``."""
    done: dict = {}

    def change(state: dict) -> dict | None:
        own = state["tables"].get(entity_type)
        if own is None or (len(own["data"]) < 2 and not own["deletes"]):
            return None
        if done.get("of") != own:
            rows = _located(spark, path, entity_type, state).drop("_file", "_at")
            done.update(of=json.loads(json.dumps(own)), name=_write_rows(rows, path, entity_type, files))
        state["tables"][entity_type] = {"data": [done["name"]], "deletes": []}
        return state

    before = snapshot(spark, path)["version"]
    return commit(spark, path, change)["version"] > before


def vacuum(spark: SparkSession, path: str, keep: int = 1, seconds: float = 7 * 86400) -> int:
    """Delete the manifests but for the last ``keep``, and the folders that none of these names and that are older than
    ``seconds`` (younger ones may belong to a commit under way); says how many folders went."""
    all_ = versions(spark, path)
    for v in all_[:-keep]:
        p, fs = _path(spark, f"{path}/manifest/{v:020d}.json")
        fs.delete(p, False)
    states = [snapshot(spark, path, v) for v in all_[-keep:]]
    named = {c for s in states for k in ("catalog", "dead", "refused") for c in s[k]} | {c for s in states for t in s["tables"].values() for k in ("data", "deletes") for c in t[k]}
    tops = [f"{path}/{k}" for k in ("catalog", "dead", "refused", "staged")] + [str(f.getPath()) for k in ("data", "deletes") for f in _children(spark, f"{path}/{k}")]
    gone = 0
    for top in tops:
        for f in _children(spark, top):
            if f.getPath().getName().removeprefix("_commit=") not in named and f.getModificationTime() / 1000 <= time.time() - seconds:
                _path(spark, top)[1].delete(f.getPath(), True)
                gone += 1
    return gone
