"""Files of arrays in the shared folder, which workers memory-map; the page cache holds what is used."""

from __future__ import annotations

import mmap
import os
import sys
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np

_U = np.uint64


def local_folder(path: str) -> str:
    """The path as workers open it."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"arrays are memory-mapped: spark.checkpoint.dir must be a mounted file system, not {url.scheme}://")
    return unquote(url.path) if url.scheme else path


def store(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Writes arrays one after another, after a line that tells their types and lengths; a retry replaces the file whole."""
    os.makedirs(folder, exist_ok=True)
    line = ",".join(f"{k}:{a.dtype.str}:{len(a)}" for k, a in arrays.items()).encode().ljust(255) + b"\n"
    part = f"{folder}/.{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(part, "wb") as out:
        out.write(line)
        for a in arrays.values():
            a.tofile(out)
            out.write(bytes(-a.nbytes % 8))
    os.replace(part, f"{folder}/{name}")


@lru_cache(maxsize=16384)
def mapped(file: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; no descriptor stays open where Python can do without."""
    with open(file, "rb") as f:
        raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))
    out, at = {}, 256
    for one in raw[:256].decode().strip().split(","):
        name, kind, n = one.split(":")
        out[name] = np.frombuffer(raw, np.dtype(kind), int(n), at)
        at += out[name].nbytes + -out[name].nbytes % 8
    return out


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash; ascending hashes have ascending parts."""
    return ((hashes >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part, and the places that belong to it, in their order."""
    order = np.argsort(part.astype(np.uint16) if len(part) and int(part.max()) < 1 << 16 else part, kind="stable")
    dealt = part[order]
    cuts = [0, *(np.flatnonzero(dealt[1:] != dealt[:-1]) + 1).tolist(), len(order)] if len(order) else [0]
    for b, e in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(dealt[b]), order[b:e]
