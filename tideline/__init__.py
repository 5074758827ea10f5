"""Ordered, uniquely keyed tables as plain Spark DataFrame plans."""

from .keyspec import Key, KeySpec
from .table import SortedTable

__all__ = ["Key", "KeySpec", "SortedTable"]
