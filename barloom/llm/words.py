"""Words and their 64-bit names for whole Arrow batches, with numpy over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_K1, _K2, _K3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

#: `[\x20\x09-\x0D]`, which also is what bytes.split() splits at
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: everything in ASCII but letters and digits
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x *= _K2
    x ^= x >> U64(27)
    x *= _K3
    x ^= x >> U64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of an ordered pair of names."""
    return mix(mix(a + _K1) * _K3 + b)


class Words:
    """Words of several texts: `name[i]` is word i, text t owns words `first[t]:first[t + 1]`."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = False):
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
        at = at - at[0]
        inside = ~separators[raw]
        before = np.empty(len(raw), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        before[at[:-1][at[:-1] < len(raw)]] = False
        self.starts = np.flatnonzero(inside & ~before)
        ends = np.ones(len(raw), bool)
        ends[:-1] = ~inside[1:]
        ends[at[1:][at[1:] > 0] - 1] = True
        self.ends = np.flatnonzero(inside & ends) + 1
        self.first = np.searchsorted(self.starts, at)
        self._raw = LOWER[raw] if lower else raw

    def __len__(self) -> int:
        return len(self.starts)

    def names(self, seed: int = 0) -> np.ndarray:
        """A 64-bit name per word from its bytes and length; two seeds together give 128 bits."""
        size = self.ends - self.starts
        padded = np.zeros(len(self._raw) + 8, np.uint8)
        padded[: len(self._raw)] = self._raw
        eights = np.ndarray((len(self._raw) + 1,), "<u8", padded, strides=(1,))
        name = mix(size.astype(U64) * _K1 + U64(seed * 2 + 1))
        live, at = np.arange(len(size)), 0
        while len(live):
            left = size[live] - at
            name[live] = mix((name[live] ^ (eights[self.starts[live] + at] & _KEEP[np.minimum(left, 8)])) * _K3 + _K1)
            at += 8
            live = live[left > 8]
        return name


def blocks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of whole texts with about `most_bytes` of text, one text at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        texts = batch.column(column)
        lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        lo = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > most_bytes:
                if i > lo:
                    held.append(batch.slice(lo, i - lo))
                yield _one(held)
                held, size, lo = [], 0, i
            size += n
        if lo < batch.num_rows:
            held.append(batch.slice(lo))
        # without text a batch would never fill up
        if sum(b.num_rows for b in held) > 200_000:
            yield _one(held)
            held, size = [], 0
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
