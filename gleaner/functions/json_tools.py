"""JSON helpers as column expressions: containment, inline relations, canonical text."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def contains(column: str, wanted: dict) -> Column:
    """Whether a JSON object holds ``wanted``: nested objects by their leaves, arrays element by element."""

    def leaves(path: str, value) -> list[Column]:
        if isinstance(value, dict):
            return [c for k, v in value.items() for c in leaves(f"{path}.{k}", v)]
        if isinstance(value, list):
            have = F.from_json(F.get_json_object(column, path), "array<string>")
            return [F.array_contains(have, v if isinstance(v, str) else json.dumps(v)) for v in value]
        got = F.get_json_object(column, path)
        return [got.isNull() if value is None else got == (value if isinstance(value, str) else json.dumps(value))]

    return F.coalesce(reduce(lambda a, b: a & b, leaves("$", wanted), F.lit(True)), F.lit(False))


def recordset(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """A JSON array of objects as a relation."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


def canonical(value) -> str:
    """Key-sorted JSON without spaces: equal values have equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
