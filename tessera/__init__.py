"""A Spark-native engine for typed flat tables: SQL, a builder and predicate lists over Parquet and versioned tables."""

from .errors import BadArgs, BadSchema, Corrupt, EngineError, NotFound, StorageError
from .operators import And, Op, Or, Pred
from .plans import query
from .session import Database

__all__ = ["And", "BadArgs", "BadSchema", "Corrupt", "Database", "EngineError", "NotFound", "Op", "Or", "Pred", "StorageError", "query"]
