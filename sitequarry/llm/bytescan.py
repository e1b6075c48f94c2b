"""Hashes of the words and of the windows of texts.

Words are hashed by blake2b to 64 bits, so nothing about the bytes of a text makes two words or
shingles equal; what decides equality rests on these.  Windows have a rolling hash modulo
2**64.  It is quick, but structured bytes (Thue-Morse words) collide in it for any base: it may choose
places, never decide that bytes are equal.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, _BASE, U), np.full(size, pow(_BASE, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _POWERS[:] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: every bit of the result depends on every bit of h."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def windows(data: np.ndarray, width: int) -> np.ndarray:
    """Rolling hashes of all stretches of that width: equal bytes have equal ones, and nothing more."""
    n = len(data) - width + 1
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n])


class _Words(dict):
    """Word -> 64 bits of blake2b; remembers at most `most` words, none of them long."""

    most = 1 << 17

    def __reduce__(self):
        return _Words, ()  # sent to executors empty

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


_WORDS = _Words()
#: Bytes of a text whose words are held at once, and what stands between words.
PIECE = 1 << 20
GAP = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text in order; A-Z count as lower case, white space is 0x20 and 0x09 to 0x0D."""
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if at + PIECE < end and (gap := GAP.search(text, at + PIECE)):
            end = gap.start()
        words = text[at:end].lower().split()  # of bytes: ASCII only, both
        out.append(np.fromiter(map(_WORDS.__getitem__, words), U, len(words)))
        at = end
    return np.concatenate(out) if out else np.empty(0, U)


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its word shingles (fewer words: the whole sequence; none: empty)."""
    own = [word_hashes(t or b"") for t in texts]
    h = np.concatenate(own) if own else np.empty(0, U)
    ends = np.cumsum([len(x) for x in own])
    k = len(h) - words + 1
    if k > 0:
        run = np.zeros(k, U)
        for i in range(words):
            run = mix(run * U(0x9FB21C651E98DF25) + h[i : i + k] + U(i + 1))
    out = []
    for x, b in zip(own, ends.tolist(), strict=True):
        n = len(x)
        if n >= words:
            out.append(np.unique(run[b - n : b - words + 1]))
        elif n:
            short = np.array([n], U)
            for w in x:
                short = mix(short * U(0xC2B2AE3D27D4EB4F) + w)
            out.append(short)
        else:
            out.append(x)
    return out


def slices(binary, most: int = 1 << 18):
    """(first, last) ranges of rows of these sizes with about `most` bytes each: the arrays above take up to 100 times the bytes."""
    at = total = 0
    for i, n in enumerate(binary):
        n = n or 0
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(binary):
        yield at, len(binary)
