"""Vectorised word and shingle hashing over whole texts.

Words are maximal runs of bytes other than the six ASCII white-space
characters; A-Z fold to a-z.  Every function works on whole texts, in chunks
whose temporaries stay near a fixed size, and gives the same 64-bit values in
every process.  An empty or null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash; `salt` selects another function."""
    h = h ^ _U((salt * 0xA0761D6478BD642F + 0x2545F4914F6CDD1D) % (1 << 64))
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def chunks(texts: list[str | None], size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded lower-case texts), about `size` bytes each time."""
    start, held, got = 0, 0, []
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        got.append(raw)
        held += len(raw)
        if held >= size:
            yield start, got
            start, held, got = i + 1, 0, []
    if got:
        yield start, got


def words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the total at the end)."""
    buf = np.frombuffer(b" ".join([b"", *raw, b""]), dtype=np.uint8)
    solid = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    at = np.flatnonzero(solid)
    ends = np.cumsum([len(r) + 1 for r in raw])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.greater(at[1:] - at[:-1], 1, out=first[1:])
    heads = np.flatnonzero(first)
    lengths = np.diff(np.append(heads, len(at)))
    place = np.arange(len(at)) - np.repeat(heads, lengths)
    part = (buf[at].astype(np.uint64) + _U(1)) * _powers(int(lengths.max()))[place]
    hashed = mix(np.add.reduceat(part, heads))
    bounds = np.concatenate([[0], np.searchsorted(at[heads], ends)])
    return hashed, bounds


def shingle_sets(raw: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes.

    A text of fewer than `width` words has its whole word sequence as the one
    shingle; a text without words has none.
    """
    hashed, bounds = words(raw)
    odd = [mix(np.array([j + 1], np.uint64), 77)[0] | _U(1) for j in range(width)]
    if len(hashed) >= width:
        whole = np.zeros(len(hashed) - width + 1, np.uint64)
        for j in range(width):
            whole += hashed[j : len(hashed) - width + 1 + j] * odd[j]
        whole = mix(whole)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            got = np.sort(whole[a : b - width + 1])
            out.append(got[np.append(True, got[1:] != got[:-1])])
        elif b > a:
            out.append(mix(np.add.reduce(hashed[a:b] * np.array(odd[: b - a], np.uint64), keepdims=True) + _U(int(b - a)), 5))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
