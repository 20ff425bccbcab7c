"""A compact exchange for per-batch values.

A task that holds millions of small values (words, names) would otherwise shuffle a row for each. It sends one packet for each
bucket instead: the batch's distinct values whose hash falls into the bucket. All packets of a bucket meet in one group, which
answers each packet, and answers go back by batch. A value that a third of all rows share is in a packet once per batch, and
buckets grow in number with the input, so a group stays of one size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.llm.store import input_partitions

#: bucket of the rows that carry a batch's documents
DOCS = -1
SCHEMA = T.StructType([T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("payload", T.BinaryType())])
ARROW = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])


def buckets_for(df: DataFrame, each: int = 4) -> int:
    """Buckets for packets of a table, in proportion to its scan."""
    return max(16, each * input_partitions(df))


def batch_ids():
    """Numbers for the batches of a task, different from those of every other task."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    return iter(range(task << 32, (task + 1) << 32))


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    """Grows with the 64-bit name, so names in order are in order of their buckets."""
    return (((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def slices(names: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the non-empty buckets of sorted names."""
    edges = np.searchsorted(bucket_of(names, buckets), np.arange(buckets + 1))
    return [(b, int(edges[b]), int(edges[b + 1])) for b in range(buckets) if edges[b + 1] > edges[b]]


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, p = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], schema=ARROW)


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_ints(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte by byte apart, which compresses best."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return squeeze(planes.tobytes(), 3)


def unpack_ints(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_small(values: np.ndarray) -> bytes:
    """Unsigned integers most of which are small: one byte below 128, two below 16512, else three, each place by itself."""
    if len(values) and int(values.max()) >= 16512 + (63 << 16):
        return pack_parts(b"\0", pack_ints(values))
    two, three = values >= 128, values >= 16512
    low = np.where(three, values - np.uint32(16512), np.where(two, values - np.uint32(128), 0)).astype(np.uint32)
    head = np.where(three, 192 + (low >> 16), np.where(two, 128 + (low >> 8), values)).astype(np.uint8)
    rest = [(low[two] & 255).astype(np.uint8), ((low[three] >> 8) & 255).astype(np.uint8)]
    return pack_parts(b"\1", *[squeeze(x.tobytes(), 3) for x in (head, *rest)])


def unpack_small(data: bytes) -> np.ndarray:
    kind, *parts = unpack_parts(data)
    if kind == b"\0":
        return unpack_ints(parts[0])
    head, second, third = (np.frombuffer(expand(p), np.uint8) for p in parts)
    out = head.astype(np.uint32)
    two, three = head >= 128, head >= 192
    low = np.zeros(len(head), np.uint32)
    low[two] = second
    middle = np.zeros(len(head), np.uint32)
    middle[three] = third
    out[two] = 128 + ((out[two] - 128) << 8) + low[two]
    out[three] = 16512 + ((head[three].astype(np.uint32) - 192) << 16) + (middle[three] << 8) + low[three]
    return out


def pack_parts(*parts: bytes) -> bytes:
    """Several byte strings as one."""
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def unpack_parts(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    size = np.frombuffer(data, "<i8", n, 8)
    ends = 8 * (n + 1) + np.cumsum(size)
    return [data[e - s : e] for s, e in zip(size.tolist(), ends.tolist(), strict=True)]


def shared_starts(values: list) -> tuple[list[int], list]:
    """How many items each sequence shares with the start of the one before, and the rest of it."""
    shared, rest, before = [], [], ()
    for value in values:
        n, most = 0, min(len(before), len(value))
        while n < most and before[n] == value[n]:
            n += 1
        shared.append(n)
        rest.append(value[n:])
        before = value
    return shared, rest


def pack_sorted(values: list[bytes]) -> bytes:
    """Sorted byte strings: how much each shares with the one before, and the rest."""
    shared, rest = shared_starts(values)
    return pack_parts(pack_ints(np.array(shared, np.int64)), pack_ints(np.fromiter(map(len, rest), np.int64, len(rest))), squeeze(b"".join(rest), 3))


def unpack_sorted(data: bytes) -> list[bytes]:
    shared, size, body = unpack_parts(data)
    shared, body = unpack_ints(shared).tolist(), expand(body)
    ends = np.cumsum(unpack_ints(size), dtype=np.int64).tolist()
    out, before = [], b""
    for n, s, e in zip(shared, [0, *ends], ends, strict=False):
        before = before[:n] + body[s:e]
        out.append(before)
    return out


def pack_table(batch: pa.RecordBatch) -> bytes:
    """Rows of any schema."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return squeeze(sink.getvalue().to_pybytes(), 3)


def unpack_table(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(expand(data)).read_next_batch()
