"""Errors of the query language."""


class QueryError(ValueError):
    """A query that can't be read or run; `position` is a character offset or None."""

    def __init__(self, message: str, position: int | None = None):
        super().__init__(message if position is None else f"{message} at position {position}")
        self.position = position
