"""Unicode normal forms, which Spark's functions lack: one Arrow pass."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


def normalized(rows: DataFrame, column: str, form: str = "NFKC") -> DataFrame:
    """``rows`` with a text column in a normal form; nulls stay."""
    if form not in FORMS:
        raise ValueError(f"no normal form {form}")
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.columns
            cols[at] = pa.array([None if t is None else t if t.isascii() else unicodedata.normalize(form, t) for t in cols[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return rows.mapInArrow(run, T.StructType(rows.schema.fields))
