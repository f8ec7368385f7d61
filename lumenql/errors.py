"""What the engine raises, by kind."""


class EngineError(Exception):
    """Any error of the engine."""


class InvalidArgument(EngineError):
    """Text that does not parse or bind, or values of the wrong kind."""


class NotFound(EngineError):
    """A table, column, function or other object that does not exist."""


class AlreadyExists(EngineError):
    """A key, or a named object, that exists."""


class FailedPrecondition(EngineError):
    """A constraint that a change would break."""


class OutOfRange(EngineError):
    """A value beyond its type's range."""


class Unimplemented(EngineError):
    """A feature that the dialect does not offer."""

class Unavailable(EngineError):
    """A fault that an observer injected."""
