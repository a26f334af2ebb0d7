"""Stored tables: Parquet files, versioned tables, encoding advice, integrity and repair."""

from .storage import peek, query, read, verify, write
from .table import Table

__all__ = ["Table", "peek", "query", "read", "verify", "write"]
