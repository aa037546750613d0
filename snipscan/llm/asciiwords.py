"""Words of letters and digits: runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case.

Every other ASCII character parts words, so ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered. In UTF-8 the bytes of
characters beyond ASCII are 0x80 or more, so the bytes are translated and split as they are.
"""

from __future__ import annotations

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()
