"""Errors that callers may want to tell apart."""


class NotFound(KeyError):
    """A record that a call names does not exist."""


class InvalidOperation(ValueError):
    """A call whose arguments make no sense together."""


class ComputationError(ValueError):
    """Vectors of unlike dimensions, or a fit without rows."""


class ImportFormatError(ValueError):
    """An export that can't be read."""
