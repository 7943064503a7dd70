"""Cuts texts where every byte-level pre-tokeniser cuts, so that equal pieces are encoded once.

A space followed by a non-space always begins a pre-token, and a line feed between non-spaces is one by
itself. A piece cut there is split and encoded alone as it would be inside its text.
"""

from __future__ import annotations

import re

#: A word of Latin letters, and marks after it: each part that is not empty is a pre-token.
WORD = re.compile("( ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-&(-/:-@[-`{-~]*)")
_BEFORE = re.compile(r"(?= \S)")
#: White space other than single spaces and line feeds between other characters; and the mark that cuts.
_ODD = ("  ", " \n", "\n ", "\n\n", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000\0", *map(chr, range(0x2000, 0x200B)))


def units(text: str) -> list[str]:
    """Pieces of text, in order; some may be empty."""
    for s in _ODD:
        if s in text:
            return _BEFORE.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
