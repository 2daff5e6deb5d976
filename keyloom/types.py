"""The four value types, and how Spark's types map to them."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class BaseType(Enum):
    FLOAT = "float"
    BOOL = "bool"
    STRING = "string"
    OBJECT = "object"


def base_type(kind: T.DataType) -> BaseType:
    """Numbers compute in double and count as FLOAT; what is no number, boolean or string keeps its Spark type as OBJECT."""
    if isinstance(kind, T.BooleanType):
        return BaseType.BOOL
    if isinstance(kind, T.NumericType):
        return BaseType.FLOAT
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return BaseType.STRING
    return BaseType.OBJECT
