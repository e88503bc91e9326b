"""Word-shingle sets of texts as sorted arrays of 64-bit hashes.

Words are runs without ASCII white space, A-Z in lower case; a set holds the
distinct runs of ``k`` words in a row, or the whole sequence of a text with
fewer words.  Hashes are polynomial prefix sums over the bytes (each byte
through a table of random 64-bit numbers), mixed at the end, and are made for
many texts at a time with NumPy.  Two different shingles have one hash with a
chance of about 2^-64.
"""

from __future__ import annotations

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
LONG_WORD = 256  # bytes; a longer word stands for its 128-bit digest
PIECE_WORDS = 20_000
BUFFER_BYTES = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            step = np.full(n, BASE, np.uint64)
            back = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step), np.cumprod(back)


POWERS = Powers()


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text, in UTF-8 (``bytes.split`` and ``lower`` treat
    exactly ASCII white space and A-Z)."""
    if not text:
        return []
    words = text.encode("utf-8", "replace").lower().split()
    if words and max(map(len, words)) > LONG_WORD:
        words = [w if len(w) <= LONG_WORD else b"\x0b" + xxhash.xxh3_128_digest(w).hex().encode() for w in words]
    return words


def _hashes(pieces: list[list[bytes]], k: int) -> list[np.ndarray]:
    """Hashes of the shingles of each piece (none empty), in text order."""
    arr = np.frombuffer(b"\n".join([b" ".join(p) for p in pieces]), np.uint8)
    n = len(arr)
    POWERS.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[arr] * POWERS.up[:n], out=sums[1:])
    cut = np.flatnonzero((arr == 32) | (arr == 10))
    starts, ends = np.concatenate([[0], cut + 1]), np.concatenate([cut, [n]])
    count = np.array([len(p) for p in pieces])
    first = np.concatenate([[0], np.cumsum(count)])
    out = []
    if len(starts) >= k:
        every = (sums[ends[k - 1:]] - sums[starts[:len(starts) - k + 1]]) * POWERS.down[starts[:len(starts) - k + 1]]
    for i, c in enumerate(count.tolist()):
        a = first[i]
        if c >= k:
            out.append(every[a:a + c - k + 1])
        else:
            out.append((sums[ends[a + c - 1]:ends[a + c - 1] + 1] - sums[starts[a]]) * POWERS.down[starts[a]])
    return out


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of every text's shingles (empty for a text
    without words).  Long texts are hashed in pieces that overlap by k - 1
    words."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    pieces: list[list[bytes]] = []
    owner: list[int] = []
    size = 0

    def flush():
        for i, h in zip(owner, _hashes(pieces, k)):
            parts[i].append(h)
        pieces.clear()
        owner.clear()
    for i, text in enumerate(texts):
        words = words_of(text)
        if not words:
            continue
        step = max(1, PIECE_WORDS - k + 1)
        for at in range(0, max(1, len(words) - k + 1), step):
            piece = words[at:at + step + k - 1]
            pieces.append(piece)
            owner.append(i)
            size += sum(map(len, piece)) + len(piece)
            if size >= BUFFER_BYTES:
                flush()
                size = 0
    if pieces:
        flush()
    return [np.unique(_mix(p[0] if len(p) == 1 else np.concatenate(p))) if p else np.zeros(0, np.uint64) for p in parts]
