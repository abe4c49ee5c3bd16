"""Errors of the query surface."""


class QueryError(Exception):
    """Base of all errors here; code is the wire code of the tool protocol."""

    code = -32099


class IndexNotReady(QueryError):
    code = -32000


class ParseError(QueryError):
    code = -32001


class ConfigCorrupt(QueryError):
    code = -32002


class SchemaVersionMismatch(QueryError):
    code = -32003


class InvalidParams(QueryError, ValueError):
    code = -32602


class SymbolNotFound(QueryError):
    """No such symbol; suggestions has up to three similar names."""

    code = -32602

    def __init__(self, message: str, suggestions: list[str] = ()):
        super().__init__(message)
        self.suggestions = list(suggestions)


class StaleIndex(QueryError):
    """Files changed since the build; dirty has their paths."""

    code = -32010

    def __init__(self, message: str, dirty: list[str] = ()):
        super().__init__(message)
        self.dirty = list(dirty)


class AlreadyReindexing(QueryError):
    code = -32014
