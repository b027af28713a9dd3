"""What can be wrong with a request."""


class TableError(Exception):
    """Any error that a user's request causes."""


class ParseError(TableError):
    """The text isn't a statement."""


class SchemaError(TableError):
    """A definition or change of a table isn't possible."""


class BadScan(TableError):
    """A scan that means nothing: an empty or mixed interval, an unknown family."""


class BadKey(TableError):
    """A cell that can't be written."""


class NoSuchTable(TableError):
    pass


class TableExists(TableError):
    pass


class Conflict(TableError):
    """Somebody else committed first."""
