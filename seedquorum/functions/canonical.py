"""Canonical JSON of nested values: keys sorted at every level, no blanks, non-ASCII characters escaped, floats in their shortest form."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.arrow_udf(StringType())
def canonical_json(value: pa.Array) -> pa.Array:
    """Text of a struct, map, array or plain value; NaN and infinities as JavaScript's names; null fields are written, a null value is ``null``.

    Map keys have to be texts. Dates, decimals and binary values have no JSON form and are an error. Java's own text of a double isn't always the
    shortest, and column functions cannot sort keys at every level, so Arrow batches go through Python's encoder.
    """
    rows = value.to_pylist(maps_as_pydicts="strict")
    return pa.array([json.dumps(x, sort_keys=True, separators=(",", ":")) for x in rows], pa.string())


def canonical_digest(value: Column) -> Column:
    """Upper-case SHA-256 of the canonical JSON."""
    return F.upper(F.sha2(canonical_json(value).cast("binary"), 256))
