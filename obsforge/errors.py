"""Why a query is refused: its text is wrong, it asks for what there is not, or for too much."""


class QueryError(Exception):
    pass


class InvalidInput(QueryError):
    """The query or its parameters make no sense."""


class Unsupported(QueryError):
    """A valid query that this engine does not answer; it never answers a part of it instead."""


class TooManyGroups(QueryError):
    """A result with more groups than the caller allows to be collected."""
