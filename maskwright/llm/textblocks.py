"""Array kernels over blocks of UTF-8 text, shared by the operators that run in Arrow workers.

Texts of a block are laid end to end in one byte array with one separator between them, and words, windows and hashes are
computed for the whole block at once. A block holds a bounded number of bytes, so memory does not follow the batch size;
a single text longer than that makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of each batch whose texts (null: empty) hold about ``limit`` bytes, with the texts as bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        col = col.cast(pa.large_binary())
        ends = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
            stop = min(stop, batch.num_rows)
            yield batch.slice(start, stop - start), [x or b"" for x in col.slice(start, stop - start).to_pylist()]
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        inverse = pow(int(_ODD), -1, 1 << 64)
        for key, base in (("up", int(_ODD)), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    up, down = _powers["up"], _powers["down"]
    if len(up) > 8 * BLOCK_BYTES:
        _powers.clear()  # tables for one very long text are not kept
    return up, down


class Words:
    """The words of a block of texts.

    ``start``/``end``: byte bounds in ``data``; ``doc``: index of the text; ``first``: for each text its first word (and one
    past the last text's); ``hash``: 64-bit hash of the word's bytes.
    """

    def __init__(self, texts: list[bytes], is_word_byte: np.ndarray):
        self.data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(lengths + 1)))
        inside = is_word_byte[self.data]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.text_start)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        up, down = _power_tables(len(self.data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], dtype=np.uint64)))
        raw = (sums[self.end] - sums[self.start]) * down[self.start]
        self.hash = mix(raw + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of ``n`` words within a text, and the index of its first word."""
        total = len(self.hash)
        if total < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.hash[: total - n + 1].copy()
        for k in range(1, n):
            h = mix(h * np.uint64(0xFF51AFD7ED558CCD) + self.hash[k : total - n + 1 + k])
        at = np.flatnonzero(self.doc[: total - n + 1] == self.doc[n - 1 :])
        return h[at], at


def byte_class(*ranges: tuple[int, int], negate: bool = False) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return ~out if negate else out


#: Words are runs of anything but space and the control characters 9 to 13.
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D), negate=True)
