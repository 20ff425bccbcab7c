"""Byte-level BPE: every distinct word of the corpus is encoded once.

Pre-tokens of a batch of documents become positions in the batch's list of distinct words. The lists are shuffled by word, so
that a word of the whole corpus is encoded in one place and once; the ids are joined back by batch, and the positions put
them into order again. Decoding joins ids with the table of token bytes, which has the size of the vocabulary.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import packets
from barloom.llm.store import cut
from barloom.llm.words import blocks
from barloom.llm.workers import released, released_groups

#: fixed values: code points with the Unicode property White_Space
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: bytes of text whose words are made distinct together
BLOCK_BYTES = 12 << 20


@functools.lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always merge the pair whose union has the lowest rank, the leftmost of equals."""
    if (known := ranks.get(word)) is not None:
        return [known]
    if len(word) > 48:
        return _encode_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    none = len(ranks) + (1 << 30)
    costs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while costs:
        low = min(costs)
        if low == none:
            break
        i = costs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i < len(costs):
            costs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, for words of any length."""
    n = len(word)
    part = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        if part[i] is None or (j := after[i]) >= n or len(part[i]) + len(part[j]) != size:
            continue  # one of the two has merged meanwhile
        part[i], part[j] = part[i] + part[j], None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := ranks.get(both := part[k] + part[after[k]])) is not None:
                heapq.heappush(heap, (r, k, len(both)))
    return [ranks[p] for p in part if p is not None]


class _Words(dict):
    """Chunk of a text (white space, then other characters) -> numbers of its pre-tokens.

    No pre-token reaches from a non-space into white space after it, so a text's pre-tokens are those of its chunks."""

    def __init__(self, pattern: str):
        import regex

        super().__init__()
        self.words: dict[str, int] = {}
        self.chunks = regex.compile(f"[{WHITE}]*+[^{WHITE}]++|[{WHITE}]++").findall
        self.pieces = regex.compile(pattern).findall

    def __missing__(self, chunk: str) -> list[int]:
        found = self[chunk] = [self.words.setdefault(w, len(self.words)) for w in self.pieces(chunk)]
        return found


def _names(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _whole(size: np.ndarray, shared: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The sequences, one after the other, from what each shares with the one before and the rest."""
    end, taken = np.cumsum(size), np.cumsum(size - shared)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint32)
    at, own = end - size + shared, size - shared
    place = np.arange(len(rest)) - np.repeat(taken - own, own) + np.repeat(at, own)
    out[place] = rest
    # item k of a sequence that shares more than k items is that of the sequence before
    for k in range(int(shared.max()) if len(shared) else 0):
        has = np.flatnonzero(size > k)
        source = np.where(shared[has] > k, 0, has)
        source = np.maximum.accumulate(source)
        # a sequence without item k ends the run, but then the next one cannot share it
        out[(end - size)[has] + k] = out[(end - size)[source] + k]
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Ids of whole texts: id, n_tokens, ids (unsigned 32-bit little-endian integers in a row; `id_array` gives an array).

    A null text counts as empty: no ids. Ids of rows are carried, never interpreted, so null and repeated ids give a row each;
    other columns are left out. A document is never split, so the longest text bounds a task's memory. The pattern must not
    let a pre-token go on from a non-space into white space.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = packets.buckets_for(slim, 1)
    id_type = slim.schema["id"].dataType

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = packets.batch_ids()
        for batch in blocks(batches, "text", block_bytes):
            known = _Words(pattern)
            texts = batch.column("text")
            found = [np.fromiter(chain.from_iterable(map(known.__getitem__, known.chunks(t))), np.uint32) if (t := texts[i].as_py()) else np.zeros(0, np.uint32) for i in range(len(texts))]
            words = [w.encode() for w in known.words]
            names = _names(words)
            del known
            # words are numbered in the order in which the packets hold them
            by_name = np.argsort(names)
            cuts = packets.slices(names[by_name], buckets)
            order = [i for _, lo, hi in cuts for i in sorted(by_name[lo:hi].tolist(), key=words.__getitem__)]
            number = np.empty(len(words), np.uint32)
            number[order] = np.arange(len(words), dtype=np.uint32)
            # positions hold numbers in the order of frequency; words met once come last, in the order of the text, and share one
            where = np.concatenate([*found, np.zeros(0, np.uint32)])
            count = np.bincount(where, minlength=len(words))
            by_count = np.argsort(-count, kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[by_count] = np.arange(len(words), dtype=np.uint32)
            often = int((count > 1).sum())
            where = np.minimum(rank[where], np.uint32(often))
            own = next(ids)
            table = packets.pack_table(pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(map(len, found)), pa.int64())], names=["id", "n"]))
            out = [(own, packets.DOCS, packets.pack_parts(table, packets.pack_small(where), packets.pack_ints(number[by_count]), str(often).encode()))]
            out += [(own, bucket, packets.pack_sorted([words[i] for i in order[lo:hi]])) for bucket, lo, hi in cuts]
            yield packets.rows(out)

    parts = cut(slim.mapInArrow(released(words_of), packets.SCHEMA), "bpe")

    def encode_bucket(group: pa.Table) -> pa.Table:
        ranks, known, out = load_ranks(ranks_path), {}, []
        for batch, bucket, payload in zip(*(group[c].to_pylist() for c in ("batch", "bucket", "payload")), strict=True):
            found = []
            for word in packets.unpack_sorted(payload):
                if (ids := known.get(word)) is None:
                    ids = known[word] = encode_word(word, ranks)
                found.append(ids)
            size = np.fromiter(map(len, found), np.int64, len(found))
            shared, rest = packets.shared_starts(found)
            out.append((batch, bucket, packets.pack_parts(*[packets.pack_ints(np.array(x, np.int64)) for x in (size, shared, list(chain.from_iterable(rest)))])))
        return pa.Table.from_batches([packets.rows(out)])

    encoded = parts.where(F.col("bucket") != packets.DOCS).groupBy("bucket").applyInArrow(released_groups(encode_bucket), packets.SCHEMA)

    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def in_order(group: pa.Table, words: pa.Table) -> pa.Table:
        sizes, flats = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for _, payload in sorted(zip(words["bucket"].to_pylist(), words["payload"].to_pylist(), strict=True)):
            size, shared, rest = (packets.unpack_ints(x) for x in packets.unpack_parts(payload))
            sizes.append(size)
            flats.append(_whole(size.astype(np.int64), shared.astype(np.int64), rest))
        size, flat = np.concatenate(sizes), np.concatenate(flats)
        start = np.cumsum(size, dtype=np.int64) - size
        names, counts, packed = [], [], []
        for payload in group["payload"].to_pylist():
            table, where, number, often = packets.unpack_parts(payload)
            table, where, number = packets.unpack_table(table), packets.unpack_small(where), packets.unpack_ints(number)
            once = np.flatnonzero(where == int(often))
            where[once] += np.arange(len(once), dtype=np.uint32)
            where = number[where]
            names.append(table.column("id"))
            at = 0
            for n in table.column("n").to_pylist():
                own = where[at : at + n]
                at += n
                lengths = size[own].astype(np.int64)
                ends = np.cumsum(lengths)
                total = int(ends[-1]) if n else 0
                counts.append(total)
                packed.append(flat[np.arange(total) + np.repeat(start[own] - ends + lengths, lengths)].astype("<u4").tobytes())
        return pa.Table.from_arrays([pa.chunked_array(names), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], names=schema.names)

    docs_rows = parts.where(F.col("bucket") == packets.DOCS)
    return docs_rows.groupBy("batch").cogroup(encoded.groupBy("batch")).applyInArrow(released_groups(in_order), schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of its ids. Null ids give null. The token table has the vocabulary's size, whatever the input."""
    schema = T.StructType([*[f for f in encoded.schema.fields if f.name != out_col], T.StructField(out_col, T.BinaryType())])
    columns = [c for c in encoded.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        tokens = {i: b for b, i in ranks.items()}
        for batch in batches:
            found = [None if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(found, pa.binary())], names=schema.names)

    return encoded.select(*columns).mapInArrow(released(run), schema)


def id_array(ids):
    """Column of packed ids as an array of integers."""

    @F.pandas_udf("array<long>")
    def unpack(packed):
        return packed.map(lambda x: None if x is None else np.frombuffer(x, "<u4").astype(np.int64))

    return unpack(ids)
