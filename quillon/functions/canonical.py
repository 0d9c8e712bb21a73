"""Canonical JSON and content addresses."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dumps(value: Any, compact: bool = False) -> str:
    """Sorted keys, ASCII only; with spaces after separators unless compact."""
    return json.dumps(value, sort_keys=True, separators=(",", ":") if compact else None)


def content_id(value: Any, size: int = 12, compact: bool = True) -> str:
    return hashlib.sha256(dumps(value, compact).encode()).hexdigest()[:size]


def canonical(column: Column, compact: bool = False) -> Column:
    """A JSON string column in canonical form. A built-in cannot do it: to_json keeps field order and non-ASCII text."""

    @F.pandas_udf("string")
    def rewrite(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else dumps(json.loads(x), compact))

    return rewrite(column)


def json_text(column: Column) -> Column:
    """A string column as a JSON string literal, natively, for ASCII text."""
    return F.get(F.split(F.to_json(F.struct(column.alias("v"))), ":", 2), F.lit(1)).substr(F.lit(1), F.length(F.get(F.split(F.to_json(F.struct(column.alias("v"))), ":", 2), F.lit(1))) - 1)
