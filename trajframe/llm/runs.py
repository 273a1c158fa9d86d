"""Runs of letters listed text by text, for the operators on words and terms. All of it works on bytes: one table step, then a split."""

from __future__ import annotations

from collections.abc import Callable, Iterator

#: Bytes of a text whose runs are listed at once.
WINDOW = 1 << 20
#: Keys of a task's table of counts before it is sent on.
TABLE = 200_000


def letters(is_letter: Callable[[int], bool]) -> bytes:
    """A table of bytes: letters stay, A-Z are lower-cased, all else becomes a blank."""
    return bytes(c + 32 if 65 <= c <= 90 else c if is_letter(c) else 32 for c in range(256))


def runs(text: str | None, encoding: str, table: bytes, window: int = WINDOW) -> Iterator[list[bytes]]:
    """The text's maximal runs of letters, in lists of those of about ``window`` bytes; what the encoding lacks is no letter."""
    raw = (text or "").encode(encoding, "replace").translate(table)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + window)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end
