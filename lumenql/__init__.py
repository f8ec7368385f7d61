"""An analytics engine on PySpark for a GoogleSQL dialect."""

from .database import COMMIT_TIMESTAMP, Database, KeyRange, KeySet, Mutation
from .errors import AlreadyExists, EngineError, FailedPrecondition, InvalidArgument, NotFound, OutOfRange, Unavailable, Unimplemented

__all__ = ["COMMIT_TIMESTAMP", "AlreadyExists", "Database", "EngineError", "FailedPrecondition", "InvalidArgument", "KeyRange", "KeySet", "Mutation", "NotFound", "OutOfRange", "Unavailable", "Unimplemented"]
