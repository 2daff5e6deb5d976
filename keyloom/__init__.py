"""keyloom: an analytics engine on functional dependencies, compiled to Spark DataFrames."""

from .functions.expressions import call, fold
from .operators.table import Column, Table
from .sources.schema import Schema

__all__ = ["Column", "Schema", "Table", "call", "fold"]
