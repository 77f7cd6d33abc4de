"""Words of a text by one byte translation: separators become blanks, capitals small letters."""

from __future__ import annotations


def translation(*letters: tuple[int, int]) -> bytes:
    """A table for ``bytes.translate``: bytes of the given ranges and of other characters than ASCII stay.

    A-Z become a-z, every other ASCII byte a blank. UTF-8 keeps all its bytes of 128 and more
    inside one character, so the words of the translated bytes are whole characters.
    """
    kept = {b for low, high in letters for b in range(low, high + 1)} | set(range(0x80, 0x100))
    return bytes(b + 32 if 0x41 <= b <= 0x5A and b in kept else b if b in kept else 0x20 for b in range(256))


LETTERS = translation((0x41, 0x5A), (0x61, 0x7A))
LETTERS_AND_DIGITS = translation((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))


def terms_of(text: bytes | None, table: bytes) -> list[bytes]:
    """The terms of a whole text in order, repeats included; none for null."""
    return text.translate(table).split() if text else []


