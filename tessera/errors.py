"""The engine's errors."""


class EngineError(Exception):
    """Any error of the engine."""


class NotFound(EngineError):
    """A file, table or snapshot does not exist."""


class Corrupt(EngineError):
    """Stored bytes fail their check."""


class StorageError(EngineError):
    """A read or write failed."""


class BadSchema(EngineError):
    """A column is unknown, repeated or of the wrong kind."""


class BadArgs(EngineError):
    """A statement or argument is malformed."""


class Conflict(StorageError):
    """Another session has written the version that was to be written."""
