"""How kernels meet Arrow: rows out of mapInArrow, and runs of sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a kernel gathers before it passes a batch on.
BATCH_ROWS = 50_000


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def map_rows(df: DataFrame, make: Callable[..., Iterator[tuple]], schema: StructType, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """For each row of df, make(*values) yields rows of schema."""
    target = to_arrow_schema(schema)

    def run(batches):
        held = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for out in make(*row):
                    held.append(out)
                if len(held) >= batch_rows:
                    yield _arrow(held, target)
                    held = []
        if held:
            yield _arrow(held, target)

    return df.mapInArrow(run, schema)


def map_runs(df: DataFrame, keys: int, make: Callable[[list[list[tuple]]], Iterator[tuple]], schema: StructType, runs_at_once: int = 1, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """df's partitions are sorted by their first ``keys`` columns; make gets ``runs_at_once`` whole runs of rows with equal keys.

    Streams: a run may span batches, and no more than the runs at hand are held. An alternative to grouped
    maps where groups are small and very many.
    """
    target = to_arrow_schema(schema)

    def run(batches):
        runs, current, key, out = [], [], None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:keys] != key and current:
                    runs.append(current)
                    current = []
                    if len(runs) >= runs_at_once:
                        out.extend(make(runs))
                        runs = []
                        if len(out) >= batch_rows:
                            yield _arrow(out, target)
                            out = []
                key = row[:keys]
                current.append(row)
        if current:
            runs.append(current)
        if runs:
            out.extend(make(runs))
        if out:
            yield _arrow(out, target)

    return df.mapInArrow(run, schema)


def packed_lists(df: DataFrame, names: list[str], out: str) -> DataFrame:
    """df with its arrays of 32-bit numbers called ``names``, of one length in a row, laid into the binary ``out``.

    A row's numbers are sorted by the first array. Of each array the lower halves of all numbers come first, then the upper
    halves, which hardly differ: what is shuffled shrinks.
    """
    kept = [c for c in df.columns if c not in names]
    target = T.StructType([*[f for f in df.schema.fields if f.name in kept], T.StructField(out, T.BinaryType())])

    def packed(parts):
        order = np.argsort(parts[0], kind="stable")
        return b"".join(x[order].view(np.uint16).reshape(-1, 2).T.tobytes() for x in parts)

    def run(batches):
        for batch in batches:
            lists = [batch.column(batch.num_columns - len(names) + i) for i in range(len(names))]
            bounds = [c.offsets.to_numpy() for c in lists]
            values = [c.values.to_numpy(zero_copy_only=False) for c in lists]
            data = [packed([v[o[k] : o[k + 1]] for v, o in zip(values, bounds, strict=True)]) for k in range(len(batch))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(data, pa.binary())], schema=to_arrow_schema(target))

    return df.select(*kept, *names).mapInArrow(run, target)


def unpacked_lists(halves: np.ndarray, counts: np.ndarray, parts: int) -> list[np.ndarray]:
    """The ``parts`` arrays of all rows, one row after the other; counts: how many halves each row has."""
    each = counts // (2 * parts)
    at = np.repeat(np.cumsum(counts) - counts - (np.cumsum(each) - each), each) + np.arange(each.sum())
    step = np.repeat(each, each)
    return [halves[at + 2 * i * step].astype(np.int32) | (halves[at + (2 * i + 1) * step].astype(np.int32) << 16) for i in range(parts)]


def _runs(batch: pa.RecordBatch):
    """(first, last + 1) of each run of equal keys, the keys, the halves in the batch's last column and their bounds by row."""
    keys, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(batch.num_columns - 1)
    bounds = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1] // 2
    halves = np.frombuffer(lists.buffers()[2] or b"", np.uint16, int(bounds[-1]))
    edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True)), keys, halves, bounds


def counted_lists(df: DataFrame, size: int) -> DataFrame:
    """df (key, packed numbers under size) with runs of one key as a row: how often each number stands in them, packed."""
    target = to_arrow_schema(df.schema)

    def run(batches):
        for batch in batches:
            if len(batch):
                runs, keys, halves, bounds = _runs(batch)
                sums = [np.bincount(unpacked_lists(halves[bounds[a] : bounds[b]], np.diff(bounds[a : b + 1]), 1)[0], minlength=size).astype(np.int32) for a, b in runs]
                data = [x.view(np.uint16).reshape(-1, 2).T.tobytes() for x in sums]
                yield pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in runs], target.field(0).type), pa.array(data, pa.binary())], schema=target)

    return df.mapInArrow(run, df.schema)


def map_lists(df: DataFrame, make: Callable[[str, tuple, np.ndarray, np.ndarray], Iterator[tuple]], schema: StructType, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """df: a key, columns that one row of a key has and others leave null, and a binary of packed lists. Dealt by key.

    make(key, the columns' values, the halves of all rows of the key, each row's count of halves) yields rows of schema. One key's
    lists are held at a time; a key without a row of values is left out.
    """
    target = to_arrow_schema(schema)
    key, value = df.columns[:2]

    def run(batches):
        held, values, parts, counts, out = None, None, [], [], []

        def done():
            return make(held, values, np.concatenate(parts), np.concatenate(counts)) if values[0] is not None else ()

        for batch in batches:
            if not len(batch):
                continue
            runs, keys, halves, bounds = _runs(batch)
            for a, b in runs:
                if keys[a] != held or not parts:
                    if parts:
                        out.extend(done())
                        if len(out) >= batch_rows:
                            yield _arrow(out, target)
                            out = []
                    held, values, parts, counts = keys[a], tuple(c[a].as_py() for c in batch.columns[1:-1]), [], []
                parts.append(halves[bounds[a] : bounds[b]])
                counts.append(np.diff(bounds[a : b + 1]))
        if parts:
            out.extend(done())
        if out:
            yield _arrow(out, target)

    return df.repartition(key).sortWithinPartitions(key, F.col(value).isNull()).mapInArrow(run, schema)
