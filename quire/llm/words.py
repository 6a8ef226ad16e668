"""Words and word shingles of whole Arrow batches, as NumPy arrays.

A word is a maximal run of bytes other than space and ``\\x09``-``\\x0D``. UTF-8 never
uses those bytes inside a character, so byte runs and character runs agree. Every helper
works on whole texts; memory is bounded by the batch, because bytes are hashed in blocks.
"""

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def mix(x):
    """A bijective 64-bit scrambler (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_CODE[_SPACE] = 0


class Batch:
    """The words of a batch of texts: byte bounds, text index and 64-bit hash of each.

    ``between`` marks the byte values that separate words (white space).
    """

    def __init__(self, texts, lower=False, hashed=True, between=_SPACE):
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        if lower:
            buf = _LOWER[buf]
        self.n, self.buf, self.off = n, buf, off
        space = between[buf]
        before = np.ones(len(buf), bool)
        before[1:] = space[:-1]
        first = off[:-1]
        before[first[first < len(buf)]] = True
        after = np.ones(len(buf), bool)
        after[:-1] = space[1:]
        after[first[first > 0] - 1] = True
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        #: first word of each text, and one past the last text's words
        self.first = np.searchsorted(self.start, off)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(n), self.counts)
        self.hash = self._hashes() if hashed else None

    def _hashes(self):
        out = np.empty(len(self.start), np.uint64)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + _BLOCK)))
            lo, hi = int(self.start[a]), int(self.end[b - 1])
            at = self.start[a:b] - lo
            code = _CODE[self.buf[lo:hi]]
            place = np.arange(hi - lo) - np.repeat(at, np.diff(np.append(at, hi - lo)))
            power = np.full(int(place.max()) + 1, _STEP)
            power[0] = 1
            code *= np.multiply.accumulate(power)[place]
            out[a:b] = np.add.reduceat(code, at)
            a = b
        return mix(out)

    def runs(self, k):
        """Hashes of the ``k`` words from each word on, and which of them end inside their text."""
        return run_hashes(self.hash, k), np.arange(len(self.start)) + k <= self.first[self.text + 1]

    def word(self, i):
        return self.buf[self.start[i] : self.end[i]].tobytes()


def run_hashes(hashes, k):
    """Polynomial hash of ``k`` consecutive items from each position (past the end: partial)."""
    n = len(hashes)
    total = np.zeros(n, np.uint64)
    done, piece, size = 0, hashes, 1
    power = {1: np.uint64(0xD6E8FEB86659FD93)}

    def ahead(x, by):
        out = np.zeros(n, np.uint64)
        if by < n:
            out[: n - by] = x[by:]
        return out

    with np.errstate(over="ignore"):
        while True:
            if k & size:
                total = total * power[size] + ahead(piece, done)
                done += size
            if 2 * size > k:
                break
            piece = piece * power[size] + ahead(piece, size)
            power[2 * size] = power[size] * power[size]
            size *= 2
        return mix(total)


def slices(batch, texts, limit=1 << 22):
    """Zero-copy slices of a record batch holding at most ``limit`` text bytes each (one text at least)."""
    size = np.zeros(len(texts), np.int64)
    if len(texts):
        import pyarrow.compute as pc

        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, side="right")))
        yield batch.slice(a, b - a)
        a = b
