"""What several operators of this folder share: Arrow passes over text columns and a worker-wide store."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows of an Arrow batch that a pass turns into Python values at a time.
SLICE_ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def tidy(work: Callable, store: str | None = None) -> Callable:
    """``work`` in a worker that first drops what other operators remember there, and gives freed memory back.

    Workers outlive stages; without this, the caches of each operator of a pipeline would add up.
    """

    def run(batches):
        kept = sys.__dict__.setdefault("_logloom_worker", {})
        for name in [n for n in kept if n != store]:
            del kept[name]
        yield from work(batches)
        pa.default_memory_pool().release_unused()

    return run


def arrow_pass(df: DataFrame, columns: list[str], work: Callable, schema: str, store: str | None = None) -> DataFrame:
    """``df.select(columns)`` through ``work`` (iterator of batches to iterator of batches), which may use ``store``."""
    return df.select(*columns).mapInArrow(tidy(work, store), schema)


def append_columns(df: DataFrame, work: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """All columns of ``df`` plus ``fields``, which ``work`` makes from each slice of a batch.

    A column of ``df`` with the name of a new one, in any case of letters, gives way to it.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in kept] + [f.name for f in fields]

    def run(batches):
        for part in slices(batches):
            arrays = [part.column(part.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays(arrays + work(part), names=names)

    return df.mapInArrow(tidy(run), T.StructType(kept + fields))


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def raw_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """UTF-8 of a text column, without decoding it."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def worker_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so its tasks share models and bounded caches.

    Functions travel to workers by value and get fresh module variables with every task; ``sys`` does not.
    """
    return sys.__dict__.setdefault("_logloom_worker", {}).setdefault(name, {})


class TwoAges:
    """Bounded cache: what was not used since the last turn of generations goes."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def turn(self) -> None:
        """Called between documents; a full generation becomes the old one."""
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
