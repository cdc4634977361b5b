"""Errors of the store. Conflicts are outcomes of a commit, not errors."""


class StoreError(Exception):
    """Base of all."""


class IoError(StoreError):
    pass


class Corruption(StoreError):
    pass


class AlreadyOpen(StoreError):
    pass


class NotFound(StoreError):
    pass


class InvalidArgument(StoreError):
    pass
