"""Words of many texts at once: spans and 64-bit hashes, vectorised over bytes."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
SEGMENT = 1 << 20


def separators(ascii_letters_only: bool = False) -> np.ndarray:
    """Table of the bytes that part words: white space, or all of ASCII but letters and digits."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    if ascii_letters_only:
        table[:128] = True
        for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
            table[a:b] = False
    return table


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 0x41) & (buf <= 0x5A), buf + np.uint8(32), buf)


def spans(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~table[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class Hasher:
    """Hashes words; keeps the tables of powers between calls."""

    def __init__(self) -> None:
        self.grow(SEGMENT)

    def grow(self, n: int) -> None:
        for name, base in (("power", _BASE), ("inverse", _BASE_INVERSE)):
            table = np.full(n + 1, base, np.uint64)
            table[0] = 1
            setattr(self, name, np.cumprod(table))

    def hashes(self, buf: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> np.ndarray:
        """Hashes of the spans from ``starts`` to each array of ``ends``, the last of which reach farthest; one row per array."""
        out, i = np.empty((len(ends), len(starts)), np.uint64), 0
        while i < len(starts):  # in segments that end between words
            j = max(i + 1, int(np.searchsorted(ends[-1], starts[i] + SEGMENT, "right")))
            lo, hi = int(starts[i]), int(ends[-1][j - 1])
            if hi - lo >= len(self.power):
                self.grow(hi - lo)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * self.power[: hi - lo], out=sums[1:])
            s = starts[i:j] - lo
            first, back = sums[s], self.inverse[s]
            for row, e in zip(out, ends, strict=True):
                row[i:j] = mix((sums[e[i:j] - lo] - first) * back)
            i = j
        return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a line feed after each, and where each begins."""
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8), begins


def groups(texts: list[bytes], size: int = SEGMENT):
    """Slices of ``texts`` of about ``size`` bytes, one text at least."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= size):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j
