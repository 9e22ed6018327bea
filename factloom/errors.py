"""Errors that calls raise; each names why a request was refused."""


class FactError(Exception):
    """Base of all errors of this package."""


class InvalidArgument(FactError):
    """A request that is malformed: an inverted range, a zero id, a duplicate."""


class NotFound(FactError):
    """Something that a request names isn't there."""


class NotSupported(FactError):
    """A column or operation that this kind of request doesn't have."""


class SchemaMismatch(FactError):
    """A value or definition that the registered properties don't allow."""


class SnapshotExpired(FactError):
    """A snapshot before the oldest one that can be read."""


class SnapshotPinned(FactError):
    """Retention or closing while snapshots are open."""


class Conflict(FactError):
    """Another commit came between a transaction's snapshot and its commit."""


class IdentityConflict(FactError):
    """An edge id that stands for two different edges."""


class UnsupportedSerializablePredicate(FactError):
    """A range read under strict isolation, which can't be validated."""


class TransactionClosed(FactError):
    """A transaction that has ended."""
