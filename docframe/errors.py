"""Errors of the engine."""


class DocframeError(Exception):
    """Any error of this package."""


class ParseError(DocframeError, ValueError):
    """A text that doesn't read: where (offset, line, column, from 0, 1 and 1) and why."""

    def __init__(self, why: str, text: str, offset: int):
        before = text[:offset]
        self.why, self.offset = why, offset
        self.line, self.column = before.count("\n") + 1, offset - (before.rfind("\n") + 1) + 1
        super().__init__(f"{why} at line {self.line} column {self.column}")


class BindError(DocframeError, ValueError):
    """A parameter that is missing, unused or of the wrong kind."""


class QueryError(DocframeError, ValueError):
    """A query, aggregate or update that is refused as written."""


class HintError(QueryError):
    """An index hint that cannot be followed."""


class UpdateError(DocframeError):
    """An update that does not suit a document."""


class DuplicateId(DocframeError):
    """An insert of an _id that is there."""


class DuplicateValue(DocframeError):
    """A write that breaks a unique index."""


class NotFound(DocframeError):
    """No such collection, document or index."""


class MultipleMatches(DocframeError):
    """An upsert whose filter matches several documents."""


class PreconditionFailed(DocframeError):
    """A requirement of a batch that doesn't hold."""


class ReadOnly(DocframeError):
    """A write to a database opened for reading."""


class SnapshotTooOld(DocframeError):
    """A snapshot whose files are gone."""


class Conflict(DocframeError):
    """Another writer committed first."""


class NotLive(QueryError):
    """A query that cannot be kept live."""


class ClosureError(DocframeError):
    """A user's function raised."""
