"""Elements of a top-level JSON array from a stream of bytes.

Brackets, strings and escapes are followed across the borders of chunks, so no more is held than one
element and one chunk.  What an element holds is not judged here; an element that is too large or not
UTF-8, and an array that doesn't begin or end as it should, is reported in its place.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

#: Limit on an element's bytes; a larger one is passed over.
MAX_ELEMENT_BYTES = 32 << 20
#: What is reported.
TOO_LARGE, BAD_UTF8 = "element_too_large", "invalid_utf8"
NOT_ARRAY, NOT_CLOSED, AFTER_ARRAY = "top_level_not_array", "array_not_closed", "text_after_array"

_BOM = b"\xef\xbb\xbf"
_BLANK = b" \t\r\n"
_MARK = re.compile(rb'["\[\]{},]')
_IN_STRING = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+', re.S)


class ArrayFramer:
    """Takes chunks of a file's bytes and gives (index, text, problem) for each element."""

    def __init__(self, limit: int = MAX_ELEMENT_BYTES):
        self.limit = limit
        self.index = 0
        self.phase = "start"  # start, before, element, after, done or stop
        self._depth, self._string, self._escaped = 0, False, False
        self._parts: list[bytes] = []
        self._held = 0
        self._head = b""

    def feed(self, chunk: bytes) -> Iterator[tuple[int, str | None, str | None]]:
        if self.phase == "start":
            chunk = self._head + chunk
            if len(chunk) < len(_BOM) and _BOM.startswith(chunk):
                self._head = chunk
                return
            rest = chunk.removeprefix(_BOM).lstrip(_BLANK)
            if not rest:
                self._head = b" "  # a mark of byte order comes first or not at all
                return
            if rest[:1] != b"[":
                self.phase = "stop"
                yield self.index, None, NOT_ARRAY
                return
            self.phase, chunk = "before", rest[1:]
        at = 0
        while at < len(chunk):
            if self.phase in ("done", "stop"):
                if self.phase == "done" and chunk[at:].strip(_BLANK):
                    self.phase = "stop"
                    yield self.index, None, AFTER_ARRAY
                return
            if self.phase != "element":
                step = len(chunk) - at - len(chunk[at:].lstrip(_BLANK)) if chunk[at] in _BLANK else 0
                at += step
                if at >= len(chunk):
                    return
                if chunk[at : at + 1] == b"]":
                    self.phase = "done"
                    at += 1
                    continue
                self.phase = "element"
            end = self._element_end(chunk, at)
            self._hold(chunk[at:end])
            at = end
            if at < len(chunk):  # at a comma or the array's end
                yield self._taken()
                self.phase = "done" if chunk[at : at + 1] == b"]" else "before"
                at += 1

    def finish(self) -> Iterator[tuple[int, str | None, str | None]]:
        """What is left to say at the end of the file."""
        if self.phase == "element":
            yield self._taken()
        if self.phase == "start":
            yield self.index, None, NOT_ARRAY
        elif self.phase not in ("done", "stop"):
            yield self.index, None, NOT_CLOSED

    def _element_end(self, chunk: bytes, at: int) -> int:
        """Where the element ends in the chunk, or the chunk's length."""
        while at < len(chunk):
            if self._string:
                if self._escaped:
                    self._escaped = False
                    at += 1
                    continue
                at = _IN_STRING.match(chunk, at).end()
                if at < len(chunk):
                    if chunk[at : at + 1] == b"\\":  # the chunk's last byte
                        self._escaped = True
                    else:
                        self._string = False
                    at += 1
                continue
            found = _MARK.search(chunk, at)
            if not found:
                return len(chunk)
            at, mark = found.start(), found[0]
            if mark == b'"':
                self._string = True
            elif mark in b"[{":
                self._depth += 1
            elif not self._depth and mark in b",]":
                return at
            elif mark in b"]}":
                self._depth = max(self._depth - 1, 0)
            at += 1
        return at

    def _hold(self, part: bytes) -> None:
        self._held += len(part)
        if self._held <= self.limit:
            self._parts.append(part)
        else:
            self._parts = []

    def _taken(self) -> tuple[int, str | None, str | None]:
        raw, held, index = b"".join(self._parts), self._held, self.index
        self._parts, self._held, self._depth = [], 0, 0
        self.index += 1
        if held > self.limit:
            return index, None, TOO_LARGE
        try:
            return index, raw.strip(_BLANK).decode("utf-8"), None
        except UnicodeDecodeError:
            return index, None, BAD_UTF8


def frame(chunks: Iterable[bytes], limit: int = MAX_ELEMENT_BYTES) -> Iterator[tuple[int, str | None, str | None]]:
    """(index, text, problem) of the elements of a file given in chunks; text or problem is None."""
    framer = ArrayFramer(limit)
    for chunk in chunks:
        yield from framer.feed(chunk)
    yield from framer.finish()
