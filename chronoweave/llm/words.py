"""Words of whole texts as 64-bit hashes, computed over byte buffers with numpy.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; A-Z are lowered first. Words of up to 64 bytes are
hashed by a polynomial of random byte values; its collisions need long words of special form, so longer words
take a cryptographic hash.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: Bytes hashed at a time; a longer word extends its piece.
PIECE = 1 << 20
#: Bytes of the longest word that the polynomial hashes.
SHORT = 64

_ODD = np.uint64(0x9E3779B97F4A7C15)
_RADIX = 0xD6E8FEB86659FD93
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; maps 0 to 0."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed, odd pseudo-random multipliers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(salt << 32)) * _ODD) | _U(1)


_BYTE = seeds(256, 7)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of the radix ("up") or of its inverse modulo 2**64 ("down")."""
    have = _powers[kind]
    if len(have) < n:
        base = _RADIX if kind == "up" else pow(_RADIX, -1, 1 << 64)
        have = np.full(max(n, 1 << 16), base, dtype=_U)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if n <= PIECE + 64:
            _powers[kind] = have
    return have


def _piece_hashes(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a piece that begins and ends at word boundaries, and where each starts."""
    gap = _SPACE[piece]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.empty(len(piece) + 1, dtype=_U)
        total[0] = 0
        np.cumsum(_BYTE[piece] * _power("up", len(piece))[: len(piece)], out=total[1:])
        raw = (total[end] - total[start]) * _power("down", len(piece) + 1)[start]
        out = mix(raw ^ ((end - start).astype(_U) * _ODD))
    for i in np.flatnonzero(end - start > SHORT).tolist():
        out[i] = int.from_bytes(blake2b(piece[start[i] : end[i]], digest_size=8).digest())
    return out, start


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and len(texts) + 1 offsets into them; a null text has no words."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    ends = np.cumsum([len(b) + 1 for b in raw]) if raw else np.zeros(0, np.int64)
    buffer = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(buffer):
        stop = min(at + PIECE, len(buffer))
        while stop < len(buffer) and not _SPACE[buffer[stop - 1]]:
            ahead = np.flatnonzero(_SPACE[buffer[stop : stop + PIECE]])
            stop = stop + int(ahead[0]) + 1 if len(ahead) else min(stop + PIECE, len(buffer))
        h, s = _piece_hashes(buffer[at:stop])
        hashes.append(h)
        starts.append(s + at)
        at = stop
    if not hashes:
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
    offsets = np.concatenate(([0], np.searchsorted(np.concatenate(starts), ends)))
    return np.concatenate(hashes), offsets.astype(np.int64)


def blocks(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Cuts a list into runs of at most `most` in total size; a larger element stands alone."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out
