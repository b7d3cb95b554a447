"""A bidirectional cursor over a fixed state, read in pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.errors import InvalidArgumentError
from tidemark.plans import ordered
from tidemark.schema import BYTEWISE, KeyOrder

#: Each page is a query, so pages are long.
PAGE = 1000


class Cursor:
    """Moves over the rows of ``state`` in key order. A page of rows around the place is held in memory.

    Stepping past either end makes the cursor invalid; reading or stepping an
    invalid cursor raises; a new seek makes it valid again.
    """

    def __init__(self, state: DataFrame, order: KeyOrder = BYTEWISE, page: int = PAGE, on_close: Callable[[], None] | None = None):
        self._state, self._order, self._page = state, order, page
        self._rows: list[tuple[object, object]] = []
        self._at = -1
        self._on_close = [on_close] if on_close else []
        self._closed = False

    # -- placing ----------------------------------------------------------------
    def _load(self, df: DataFrame, reverse: bool) -> None:
        rows = [(r["key"], r["value"]) for r in df.select("key", "value").collect()]
        rows = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows]
        self._rows = rows[::-1] if reverse else rows
        self._at = (len(rows) - 1 if reverse else 0) if rows else -1

    def seek_to_first(self) -> Cursor:
        self._load(ordered.page(self._state, None, self._page, self._order), False)
        return self

    def seek_to_last(self) -> Cursor:
        self._load(ordered.page(self._state, None, self._page, self._order, reverse=True), True)
        return self

    def seek(self, target: object) -> Cursor:
        """To the first key at or after ``target``."""
        rest = ordered.key_range(self._state, target, None, self._order)
        self._load(ordered.page(rest, None, self._page, self._order), False)
        return self

    # -- moving -----------------------------------------------------------------
    def _need(self) -> None:
        if not self.valid():
            raise InvalidArgumentError("cursor isn't on a row")

    def next(self) -> Cursor:
        self._need()
        if self._at + 1 < len(self._rows):
            self._at += 1
        else:
            self._load(ordered.page(self._state, self.key(), self._page, self._order), False)
        return self

    def prev(self) -> Cursor:
        self._need()
        if self._at > 0:
            self._at -= 1
        else:
            self._load(ordered.page(self._state, self.key(), self._page, self._order, reverse=True), True)
        return self

    # -- reading ----------------------------------------------------------------
    def valid(self) -> bool:
        return not self._closed and 0 <= self._at < len(self._rows)

    def key(self) -> object:
        self._need()
        return self._rows[self._at][0]

    def value(self) -> object:
        self._need()
        return self._rows[self._at][1]

    def status(self) -> None:
        """Errors are raised where they occur; a cursor that answers is sound."""

    def on_close(self, call: Callable[[], None]) -> None:
        self._on_close.append(call)

    def close(self) -> None:
        if not self._closed:
            self._closed, self._rows = True, []
            for call in self._on_close:
                call()

    def __enter__(self) -> Cursor:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def __iter__(self):
        self.seek_to_first()
        while self.valid():
            yield self.key(), self.value()
            self.next()
