"""Errors of the engine and predicates on them."""

from __future__ import annotations


class StoreError(Exception):
    """Base of all errors; the text starts with the kind."""

    kind = "Error"

    def __init__(self, message: str = "", detail: str | None = None):
        self.message, self.detail = message, detail
        text = message if detail is None else f"{message}: {detail}"
        super().__init__(f"{self.kind}: {text}")


class NotFoundError(StoreError):
    kind = "NotFound"


class CorruptionError(StoreError):
    kind = "Corruption"


class UnsupportedError(StoreError):
    kind = "Not implemented"


class InvalidArgumentError(StoreError):
    kind = "Invalid argument"


class StorageError(StoreError):
    kind = "IO error"


def is_not_found(e: BaseException | None) -> bool:
    return isinstance(e, NotFoundError)


def is_corruption(e: BaseException | None) -> bool:
    return isinstance(e, CorruptionError)


def is_io_error(e: BaseException | None) -> bool:
    return isinstance(e, StorageError)


def is_not_supported(e: BaseException | None) -> bool:
    return isinstance(e, UnsupportedError)


def is_invalid_argument(e: BaseException | None) -> bool:
    return isinstance(e, InvalidArgumentError)
