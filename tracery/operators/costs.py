"""Batches of bounded cost: the greedy cut of a long key by many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored

#: Rows that are cut at once.
CHUNK = 10_000
_OWN = "_cost double, _chunk long, _at long, _ends array<double>, _cuts array<long>, _left array<double>, _all double"


def cost_batches(costs: np.ndarray, most: float) -> np.ndarray:
    """Numbers of consecutive batches whose cost stays within ``most``; a dearer row is a batch of its own."""
    out, batch, total = np.zeros(len(costs), np.int64), 0, 0.0
    for k, c in enumerate(costs):
        if k and total + c > most:
            batch, total = batch + 1, 0.0
        total += c
        out[k] = batch
    return out


def next_starts(costs: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Costs added up, and for a batch that starts at each row, where the next one starts (beyond the end if nowhere)."""
    ends = np.cumsum(costs)
    before = np.concatenate([[0.0], ends[:-1]])
    return ends, np.maximum(np.searchsorted(ends, before + most, side="right"), np.arange(1, len(costs) + 1))


def summary(costs: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """What a chunk does to any batch that comes into it: the costs added up at each row where its first cut can be, and for a
    cut there, how many more follow and what the last batch costs so far. Jumps from start to start are doubled."""
    n = len(costs)
    ends, hop = next_starts(costs, most)
    hop = np.append(hop, n)
    cuts = np.append(hop[:n] < n, False).astype(np.int64)
    last = np.where(hop < n, hop, np.arange(n + 1))
    for _ in range(n.bit_length()):
        cuts, hop, last = cuts + cuts[hop], hop[hop], last[last]
    left = ends[-1] - np.concatenate([[0.0], ends])[last[:n]]
    reach = min(n, int(np.searchsorted(ends, most, side="right")) + 1)
    return ends[:reach], cuts[:reach], left[:reach], float(ends[-1])


def _chunks(batches: Iterator[pa.RecordBatch], most: float, size: int) -> Iterator[pa.RecordBatch]:
    """Each row with its chunk and place there; a chunk's first row carries what the chunk does."""
    number = TaskContext.get().partitionId() << 32
    for b in batches:
        n = b.num_rows
        key = b.column("_key").to_numpy(zero_copy_only=False)
        costs = b.column("_cost").to_numpy(zero_copy_only=False)
        begins = np.union1d(np.flatnonzero(np.append(True, key[1:] != key[:-1])) if n else [], np.arange(0, n, size)).astype(np.int64)
        chunk, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        own: list[list] = [[None] * n for _ in range(4)]
        for a, z in zip(begins, np.append(begins[1:], n), strict=True):
            chunk[a:z], at[a:z], number = number, np.arange(z - a), number + 1
            for column, x in zip(own, summary(costs[a:z], most), strict=True):
                column[a] = x
        kinds = [pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64()]
        new = [pa.array(chunk), pa.array(at), *[pa.array(x, k) for x, k in zip(own, kinds, strict=True)]]
        yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "_chunk", "_at", "_ends", "_cuts", "_left", "_all"])


def _entries(batches: Iterator[pd.DataFrame], most: float) -> Iterator[pd.DataFrame]:
    """The batch and its cost so far with which each chunk begins; no cost at a key's first chunk."""
    key, batch, total = None, 0, None
    for b in batches:
        out = []
        for own, chunk, ends, cuts, left, whole in zip(b["_key"], b["_chunk"], b["_ends"], b["_cuts"], b["_left"], b["_all"], strict=True):
            if own != key:
                key, batch, total = own, 0, None
            out.append((chunk, batch, total))
            k = 0 if total is None else int(np.searchsorted(ends, most - total, side="right"))
            if k == len(ends):
                total += whole
            else:
                batch, total = batch + int(cuts[k]) + (total is not None), float(left[k])
        yield pd.DataFrame(out, columns=["_chunk", "_batch", "_total"]).astype({"_total": "float64"})


def _numbered(rows: pa.Table, entry: pa.Table, most: float, names: list[str]) -> pa.Table:
    rows = rows.sort_by("_at")
    ends, after = next_starts(rows["_cost"].to_numpy(), most)
    total = entry["_total"][0].as_py()
    first = total is None or np.isnan(total)
    marks = np.zeros(len(ends) + 1, np.int64)
    k = 0 if first else int(np.searchsorted(ends, most - total, side="right"))
    marks[k] = 0 if first else 1
    while k < len(ends):
        k = after[k]
        marks[k] = 1
    return rows.select(names).append_column("batch", pa.array(entry["_batch"][0].as_py() + np.cumsum(marks[:-1])))


def batch_by_cost(df: DataFrame, keys: list[str], order: list[str], cost: str, most: float, chunk: int = CHUNK) -> DataFrame:
    """Each row's ``batch`` number in its key, in order: consecutive rows whose costs add up to ``most`` at most.

    Rows are sorted by ranges of key and order, so that many tasks share a long key, and cut into chunks of ``chunk`` rows at
    most. Where a batch that comes into a chunk is cut first, decides all other cuts there; so each chunk is summed up by the
    places of that first cut, one task passes over a key's chunks (not its rows), and all chunks are numbered apart.

    A row dearer than ``most`` is a batch of its own. NULL and negative costs count 0; NULL keys are a key. Rows that
    ``order`` doesn't tell apart come in any order. Costs are added up as doubles, exactly if they are whole numbers."""
    cost_of = F.greatest(F.coalesce(F.col(cost).cast("double"), F.lit(0.0)), F.lit(0.0))
    named = df.withColumns({"_key": F.to_json(F.struct(*keys)), "_cost": cost_of})
    placed = named.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*df.schema.fields, T.StructField("_key", T.StringType()), *T._parse_datatype_string(_OWN).fields])
    rows = stored(placed.mapInArrow(lambda x: _chunks(x, most, chunk), schema))
    sums = rows.where("_all is not null").select("_key", "_chunk", "_ends", "_cuts", "_left", "_all")
    entries = sums.repartition("_key").sortWithinPartitions("_key", "_chunk").mapInPandas(lambda x: _entries(x, most), "_chunk long, _batch long, _total double")
    names = df.columns
    out = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])
    slim = rows.select(*names, "_cost", "_chunk", "_at")
    return slim.groupBy("_chunk").cogroup(entries.groupBy("_chunk")).applyInArrow(lambda a, b: _numbered(a, b, most, names), out)
