"""Redaction of JSON by key, with bounds on depth, width and length."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TEXT, MAX_ITEMS, MAX_KEYS = 4000, 48, 64
HIDDEN = "[redacted]"


def redact_value(value, secret: tuple[str, ...]):
    """value with the values of secret keys hidden and long parts cut."""
    if isinstance(value, dict):
        return {k: HIDDEN if any(s == k.lower() or len(s) > 2 and s in k.lower() for s in secret) else redact_value(v, secret) for k, v in list(value.items())[:MAX_KEYS]}
    if isinstance(value, list):
        return [redact_value(v, secret) for v in value[:MAX_ITEMS]]
    if isinstance(value, str) and len(value) > MAX_TEXT:
        return value[:MAX_TEXT] + "..."
    return value


def redact_json(column: Column, secret: tuple[str, ...]) -> Column:
    """JSON text redacted in Arrow batches; text that isn't JSON comes back cut to length."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            try:
                return json.dumps(redact_value(json.loads(v), secret), ensure_ascii=False, sort_keys=True)
            except ValueError:
                return v[:MAX_TEXT]

        return values.map(one)

    return run(column)
