"""Vectorised hashing of words and byte spans of many texts at once, in numpy.

A family holds two polynomial hashes modulo the prime 2**31 - 1 with unrelated bases and codes, together 62 bits.
Prefix sums of ``code * base**i`` give the hash of any span by one subtraction and one multiplication. The modulus is
a prime, since modulo a power of two some strings (Thue-Morse words) collide for every base.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_MASK = (1 << 64) - 1
PRIME = (1 << 31) - 1
#: Spans are hashed over about so many bytes at a time.
BLOCK, STEP = 1 << 21, 1 << 14


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values from a fixed seed."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0x632BE59BD9B4E019 & _MASK))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _fold(x: np.ndarray) -> np.ndarray:
    """Change x, in place, into a smaller number with the same residue: below 2**33 from any x, below 2**32 + 4 from x < 2**63."""
    high = x >> U(31)
    x &= U(PRIME)
    x += high
    return x


def _residue(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, in place."""
    x = _fold(_fold(x))
    x -= (x >= U(PRIME)).astype(U) * U(PRIME)
    return x


class Family:
    """Span hashes of bytes, or of 64-bit values when ``codes`` is None."""

    def __init__(self, seed: int, codes: bool = True):
        self.bases = [int(x) % (PRIME - 2) + 2 for x in splitmix(2, seed)]
        self.inverses = [pow(b, PRIME - 2, PRIME) for b in self.bases]
        self.codes = [splitmix(256, seed * 100 + k) % U(PRIME - 1) + U(1) for k in range(2)] if codes else None
        self.up = [np.ones(1, dtype=U) for _ in range(2)]
        self.down = [np.ones(1, dtype=U) for _ in range(2)]

    def _grow(self, n: int) -> None:
        for powers, bases in ((self.up, self.bases), (self.down, self.inverses)):
            for k in range(2):
                p = powers[k]
                while len(p) < n:
                    p = np.concatenate((p, _residue(p * U(pow(bases[k], len(p), PRIME)))))
                powers[k] = p

    def prefix(self, values: np.ndarray) -> list[np.ndarray]:
        """Running sums for ``span``, one more than values."""
        n = len(values)
        self._grow(n + 1)
        out = [np.empty(n + 1, dtype=U) for _ in range(2)]
        for k, sums in enumerate(out):
            sums[0] = 0
            for i in range(0, n, STEP):  # in pieces that stay in the cache
                own = values[i : i + STEP]
                code = np.take(self.codes[k], own) if self.codes else _fold((own >> U(32 * k)) & U(0xFFFFFFFF))
                code *= self.up[k][i : i + len(own)]
                _fold(code)[0] += sums[i]
                np.cumsum(code, out=sums[i + 1 : i + 1 + len(own)])
        return out

    def span(self, prefix: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end], equal for equal spans of equal length wherever they stand."""
        a, b = (_residue(_fold(_fold(prefix[k][end] - prefix[k][start])) * self.down[k][start]) for k in range(2))
        return mix((a << U(31) | b) + (end - start).astype(U) * U(0xD6E8FEB86659FD93))

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``span`` of ascending spans that do not overlap, block by block, so that long data need no long sums."""
        out = np.empty(len(start), dtype=U)
        cuts = np.searchsorted(start, np.arange(0, len(data) + BLOCK, BLOCK)) if len(start) else np.zeros(1, dtype=np.int64)
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if j > i:
                low = start[i]
                out[i:j] = self.span(self.prefix(data[low : max(end[j - 1], low)]), start[i:j] - low, end[i:j] - low)
        return out

    def short(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``span`` of short spans in any order, which may overlap, block by block."""
        if len(values) <= BLOCK:
            return self.span(self.prefix(values), start, end)
        out, block = np.empty(len(start), dtype=U), start // BLOCK
        for k in np.unique(block):
            own, low = np.flatnonzero(block == k), k * BLOCK
            out[own] = self.span(self.prefix(values[low : end[own].max()]), start[own] - low, end[own] - low)
        return out


def choices(data: np.ndarray, width: int) -> np.ndarray:
    """32 bits for every run of ``width`` bytes, to choose places by; they tell nothing apart."""
    n = max(0, len(data) - width + 1)
    h = np.zeros(n, dtype=np.uint32)
    codes = (splitmix(256, 11) & U(0xFFFFFFFF)).astype(np.uint32)
    size, span, done = 1, codes[data], 0  # the hash of 2k bytes is made of two hashes of k bytes
    while True:
        if width & size:
            h = h * np.uint32(0x9E3779B1) + span[done : done + n]
            done += size
        size *= 2
        if size > width:
            break
        span = span[: len(span) - size // 2] * np.uint32((0x85EBCA77 ^ size * 0x27D4EB2F) & 0xFFFFFFFF | 1) + span[size // 2 :]
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return h ^ (h >> np.uint32(15))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Families for bytes, two of them unrelated, and for the hashes of words.
BYTES, BYTES2, WORDS = Family(1), Family(2), Family(3, codes=False)


class Batch:
    """Texts joined into one byte buffer, one newline after each; ``base`` has len + 1 starts."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        self.base = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(self.sizes + 1, out=self.base[1:])
        self.raw = raw
        self.bytes = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8) if raw else np.zeros(0, np.uint8)
        if lower:
            self.bytes = LOWER[self.bytes]

    def prefix(self) -> list[np.ndarray]:
        return BYTES.prefix(self.bytes)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte start and end of every word, and each text's first word (len + 1 values)."""
        space = IS_SPACE[self.bytes]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        return start, end, np.searchsorted(start, self.base)

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and each text's first word."""
        start, end, first = self.words()
        return BYTES.spans(self.bytes, start, end), first


def chunks(pdf, text: str = "text", most: int = 2_000_000):
    """Row slices of a pandas frame with about ``most`` characters each; a longer text stands alone."""
    sizes = pdf[text].str.len().fillna(0).to_numpy(dtype=np.int64) + 1
    group = (np.cumsum(sizes) - 1) // most
    for cut in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(group)) + 1):
        if len(cut):
            yield pdf.iloc[cut[0] : cut[-1] + 1]


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's LongType holds them."""
    return x.view(np.int64)
