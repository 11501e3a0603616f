"""Exceptions with the exit codes of a command: 0 ok, 1 general, 2 not found, 3 invalid input."""


class SiftwellError(Exception):
    exit_code = 1


class NotFound(SiftwellError):
    exit_code = 2


class CollectionNotFound(NotFound):
    pass


class DocumentNotFound(NotFound):
    pass


class InvalidInput(SiftwellError):
    exit_code = 3


class SourceError(SiftwellError):
    """A source could not be read."""
