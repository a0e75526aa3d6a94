"""Words and rolling hashes of Arrow text batches in numpy: whole batches at a time, no loop over words.

A hash of bytes s..e is (H[e] - H[s]) * B^-s with H the running sum of (byte + 1) * B^i, all modulo 2^64 with an odd B;
a finaliser then mixes the bits. Equal strings have equal hashes wherever they stand; unequal ones meet with a
probability near 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_B = 0x9E3779B97F4A7C15 | 1
_K = 0xD1342543DE82EF95 | 1
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^(n-1) and their inverses modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) < n:
        most = max(n, SLICE_BYTES + 1)
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            steps = np.full(most, x, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[base] = (both[0], both[1])
    up, down = _powers[base]
    return up[:n], down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


def spans_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Mixed hashes of the given spans of what `running` summed."""
    return mixed((total[end] - total[start]) * powers(base, len(total))[1][start])


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: empty) and the n + 1 places where they start and end."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices of about `most` bytes of text (a longer text is alone), so memory is bounded."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        total = np.concatenate([[0], np.cumsum(size)])
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of texts: start, end (bytes in data), first (word offsets by text), hash. White space parts words, or
    whatever isn't marked in `inside`, a table of the 256 bytes."""

    def __init__(self, texts: pa.Array, lower: bool = False, inside: np.ndarray | None = None):
        self.data, self.at = flat(texts)
        data = self.folded = _LOWER[self.data] if lower else self.data
        inside = ~_SPACE[data] if inside is None else inside[data]
        n = len(data)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = self.at[(self.at > 0) & (self.at < n)]
        before[edges], after[edges - 1] = False, False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.hash = spans_hash(running(data.astype(np.uint64) + np.uint64(1), _B), self.start, self.end, _B)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of n words within one text."""
        counts = self.counts
        last = np.repeat(self.first[1:], counts)
        start = np.arange(len(self.start))
        start = start[start + n <= last]
        return start, self.spans(start, start + n)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return spans_hash(running(self.hash, _K), start, end, _K)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)
