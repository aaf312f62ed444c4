"""Helpers for Arrow-batched Python steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame


def place(names: list[str], name: str) -> int:
    """Where a column is: the first of exactly this name, else the only one that differs in case."""
    if name in names:
        return names.index(name)
    like = [i for i, n in enumerate(names) if n.lower() == name.lower()]
    if len(like) != 1:
        raise ValueError(f"no column {name} among {names}")
    return like[0]


def by_place(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns named by place, and its own names; no name of its own can then clash with a helper's."""
    names = df.columns
    return df.toDF(*[f"_c{i}" for i in range(len(names))]), names


def columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only; a missing one is an error, extra ones go, whatever their names."""
    plain, own = by_place(df)
    return plain.select(*[plain[f"_c{place(own, n)}"].alias(n) for n in names])


def byte_texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``rows`` rows and about ``size`` bytes of a column (one row at least)."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(name)).fill_null(0).to_pylist()
        at = 0
        while at < len(lengths):
            end, total = at, 0
            while end < len(lengths) and end - at < rows and (end == at or total + lengths[end] <= size):
                total += lengths[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end
