"""Schemas that can be named before there is a session."""

from __future__ import annotations

from pyspark.sql import types as T

TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def record(columns: str) -> T.StructType:
    """'name type, ...' of plain types as a struct."""
    return T.StructType([T.StructField(n, TYPES[t]) for n, t in (c.split() for c in columns.split(", "))])
