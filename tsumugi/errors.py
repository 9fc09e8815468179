"""Typed errors with stable numeric codes."""


class TsumugiError(Exception):
    code = 0


class DataNotFound(TsumugiError):
    code = 1


class DataVersionMismatch(TsumugiError):
    code = 2

    def __init__(self, expected: int, found: int | None):
        super().__init__(f"format {expected} expected, {found} found")
        self.expected, self.found = expected, found


class DataCorrupted(TsumugiError):
    code = 3


class InvalidQuery(TsumugiError):
    code = 4


class StorageError(TsumugiError):
    code = 5


class DeserializationError(TsumugiError):
    code = 6


class CacheDirRequired(TsumugiError):
    code = 7


class NetworkError(TsumugiError):
    code = 8


class CacheDirAlreadySet(TsumugiError):
    code = 9
