"""Schemas from text without a running session."""

from __future__ import annotations

from pyspark.sql import types as T

PLAIN = {
    "string": T.StringType, "int": T.IntegerType, "bigint": T.LongType, "double": T.DoubleType, "float": T.FloatType,
    "boolean": T.BooleanType, "binary": T.BinaryType, "timestamp": T.TimestampType,
}


def _parts(text: str) -> list[str]:
    """Split at the commas outside of <>."""
    out, depth, begin = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(text[begin:k])
            begin = k + 1
    return [p.strip() for p in [*out, text[begin:]]]


def data_type(text: str) -> T.DataType:
    text = text.strip()
    if text.startswith("array<"):
        return T.ArrayType(data_type(text[6:-1]))
    if text.startswith("struct<"):
        return T.StructType([T.StructField(n.strip(), data_type(t)) for n, _, t in (p.partition(":") for p in _parts(text[7:-1]))])
    return PLAIN[text]()


def schema(text: str) -> T.StructType:
    """Of "name type, name type, ..."."""
    return T.StructType([T.StructField(n, data_type(t)) for n, _, t in (p.partition(" ") for p in _parts(text))])
