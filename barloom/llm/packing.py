"""Best-fit packing of token pieces into sequences of a fixed length, by exact complements.

Texts are cut at white space, which no token crosses; every distinct chunk of a task is encoded once by the tokenizer library,
and what it learnt stays, within bounds, for the next task of its process.
Only how many pieces have which length matters for packing, a histogram of at most `size` counts whatever the input. The plan
looks up, for the gap that a piece leaves, single lengths, pairs and triples whose sum is that gap, and consumes as many of them
as are there; what stays is placed by best fit, longest first, equal bins together. A plan is a list of patterns with how often
each is used. Pieces of a length are interchangeable, so a piece finds its place by its number among the pieces of its length.
"""

from __future__ import annotations

import bisect
import contextlib
import gc
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from itertools import repeat
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import words
from barloom.llm.store import cut
from barloom.llm.workers import released

#: bytes of text encoded together, and bytes of distinct chunks that a process remembers before it starts anew
BLOCK_BYTES, REMEMBERED = 4 << 20, 8 << 20
#: (how often, ((length, copies), ...))
Pattern = tuple[int, tuple[tuple[int, int], ...]]


#: letters that lower-casing and composing leave single characters, and marks that stand for themselves behind them
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(f"([{LETTERS}]+)([.,;:!?]*)")


class Chunks:
    """Ids of texts by those of their chunks between ASCII white space.

    A chunk of plain letters and marks is one or two words of the tokenizer, which its model takes as they are; any other chunk
    goes through the whole library, special strings, normalising and splitting included.
    """

    #: what the last task of this process has read and learnt, for the next one
    _kept: ClassVar[dict[tuple[str, int], Chunks]] = {}

    @classmethod
    @contextlib.contextmanager
    def lent(cls, path: str, end_id: int) -> Iterator[Chunks]:
        """The chunks that this process knows already, for one task at a time. A task that fails or stops early leaves none."""
        chunks = cls._kept.pop((path, end_id), None) or cls(path, end_id)
        cls._kept.clear()
        yield chunks
        cls._kept[path, end_id] = chunks

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._library, self._end = Tokenizer.from_file(path), end_id
        self._library.no_truncation()
        self._library.no_padding()
        self._model, as_bytes = self._library.model, ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(128, 256) if PLAIN.fullmatch(chr(c))]
        self._bytes = str.maketrans({c: as_bytes.pre_tokenize_str(c)[0][0] for c in letters})
        self._forget()

    def _forget(self) -> None:
        self._code: dict[bytes | None, int] = {None: 0}
        self._words: dict[str, array] = {}
        self._ids, self._ends, self._held = array("I", [self._end]), [1], 0

    def _word(self, word: str) -> array:
        """Ids of one word of the tokenizer, in lower case."""
        found = self._words.get(word)
        if found is None:
            found = self._words[word] = array("I", [t.id for t in self._model.tokenize(word if word.isascii() else word.translate(self._bytes))])
        return found

    def _learn(self, new: Iterable[bytes]) -> None:
        odd, code, held, ends, known = [], self._code, self._ids, self._ends, self._words.get
        for chunk in new:
            text = chunk.decode("utf-8", "replace")
            plain = PLAIN.fullmatch(text)
            self._held += len(chunk)
            if plain is None:
                odd.append((chunk, text))
                continue
            word, marks = plain.groups()
            word = word.lower()
            held.extend(known(word) or self._word(word))
            if marks:
                held.extend(known(marks) or self._word(marks))
            code[chunk] = len(ends)
            ends.append(len(held))
        for lo in range(0, len(odd), 4096):
            some = odd[lo : lo + 4096]
            found = self._library.encode_batch_fast([text for _, text in some], add_special_tokens=False)
            for (chunk, _), one in zip(some, found, strict=True):
                held.extend(one.ids)
                code[chunk] = len(ends)
                ends.append(len(held))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by the end id, and where each text ends."""
        if self._held > REMEMBERED:
            self._forget()
        every: list[bytes | None] = []
        counts = []
        for text in texts:
            every += text.split()
            every.append(None)
            counts.append(len(every))
        codes = np.fromiter(map(self._code.get, every, repeat(-1)), np.int64, len(every))
        unmet = np.flatnonzero(codes < 0)
        chunks = [every[i] for i in unmet.tolist()]
        self._learn(set(chunks))
        codes[unmet] = np.fromiter(map(self._code.__getitem__, chunks), np.int64, len(chunks))
        ends = np.array(self._ends)
        size = np.diff(ends, prepend=0)[codes]
        to = np.cumsum(size)
        ids = np.array(self._ids, np.uint32)[np.repeat(ends[codes] - to, size) + np.arange(to[-1] if len(to) else 0)]
        return ids, to[np.array(counts, np.int64) - 1]


def pieces(docs: DataFrame, path: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The id, piece, start, length, ids (unsigned 32-bit little-endian), and the piece's number among those of its length in
    its task."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("start", "length")], T.StructField("ids", T.BinaryType()), T.StructField("_task", T.IntegerType()), T.StructField("_turn", T.LongType())])

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        met = np.zeros(size + 1, np.int64)
        gc.disable()  # millions of words and no cycles; the collector would walk them again and again
        with Chunks.lent(path, end_id) as chunks:
            for block in words.blocks(batches, "_text", BLOCK_BYTES):
                ids, ends = chunks.encode(block.column("_text").to_pylist())
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                parts = -(-(ends - starts) // size)
                doc = np.repeat(np.arange(len(ends)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * size
                length = np.minimum(size, (ends - starts)[doc] - start)
                by = np.argsort(length, kind="stable")
                run = length[by]
                turn = np.empty(len(by), np.int64)
                turn[by] = np.arange(len(by)) - np.searchsorted(run, run) + met[run]
                met += np.bincount(length, minlength=size + 1)
                places = pa.py_buffer(np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int64))
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, places, pa.py_buffer(ids.astype("<u4"))])
                names = block.column("_id").take(pa.array(doc))
                columns = [names, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), data, pa.array(np.full(len(doc), task), pa.int32()), pa.array(turn)]
                for lo in range(0, len(doc), 1000):  # a binary column of a batch holds less than 2 GB
                    part = [c.slice(lo, 1000) for c in columns]
                    part[4] = part[4].cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(part, names=schema.names)
        gc.enable()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text")).mapInArrow(released(cut_texts), schema)


def _times(left: np.ndarray, lengths: tuple[int, ...]) -> int:
    """How often these lengths can still be taken together."""
    return min(int(left[x]) // n for x, n in Counter(lengths).items())


def _complements(left: np.ndarray, size: int, most: int) -> Iterator[tuple[int, ...]]:
    """Combinations that fill a sequence exactly; `left` changes between them. First pieces that need no other, then for the gap
    beside every piece, longest first, a single length; then pairs by their sum; then triples by a length and the sum of the
    pair beside it. Complements are of `most` pieces at most."""

    def pairs(total: int, longest: int) -> Iterator[tuple[int, int]]:
        a = np.arange(max(1, -(-total // 2)), min(total, longest + 1))
        for x in a[(left[a] > 0) & (left[total - a] > 0)][::-1].tolist():
            yield x, total - x

    def triples(total: int, longest: int) -> Iterator[tuple[int, int, int]]:
        for a in np.flatnonzero(left[: max(0, min(longest, total - 2) + 1)])[::-1].tolist():
            if 3 * a < total:
                return
            for b, c in pairs(total - a, a):
                yield a, b, c

    def singles(total: int, longest: int) -> Iterator[tuple[int]]:
        if 0 < total <= longest and left[total]:
            yield (total,)

    if left[size]:
        yield (size,)
    for ways in (singles, pairs, triples)[:most]:
        for x in range(size - 1, 0, -1):
            if left[x]:
                for beside in ways(size - x, x):
                    yield x, *beside
                    if not left[x]:
                        break


def plan(counts: Mapping[int, int], size: int) -> list[Pattern]:
    """Patterns that hold every piece of the histogram once. Complements of up to three pieces are consumed before best fit; where
    fewer pieces beside each other leave fewer sequences, as short ones are scarce, that plan is taken."""
    plans = [_plan(counts, size, most) for most in (3, 2, 1, 0)]
    return min(plans, key=lambda p: sum(times for times, _ in p))


def _plan(counts: Mapping[int, int], size: int, most: int) -> list[Pattern]:
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    found: list[Pattern] = []
    for lengths in _complements(left, size, most):
        times = _times(left, lengths)
        if times:
            for x in lengths:
                left[x] -= times
            found.append((times, tuple(sorted(Counter(lengths).items(), reverse=True))))
    # best fit, longest first: bins of one gap and content are one entry
    gaps: list[int] = []
    bins: dict[int, list[Pattern]] = {}

    def keep(gap: int, times: int, content: tuple[tuple[int, int], ...]) -> None:
        if times:
            if gap not in bins:
                bisect.insort(gaps, gap)
            bins.setdefault(gap, []).append((times, content))

    for x in range(size, 0, -1):
        n = int(left[x])
        while n:
            at = bisect.bisect_left(gaps, x)
            if at < len(gaps):
                gap = gaps[at]
                times, content = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap], gaps[at]
            else:
                gap, content = size, ()
                times = -(-n // (size // x))
            # the next piece of this length fits best where the last one went, until that bin is full
            each = gap // x
            full = min(times, n // each)
            keep(gap - each * x, full, (*content, (x, each)))
            n, times = n - full * each, times - full
            if times and n and n < each:
                keep(gap - n * x, 1, (*content, (x, n)))
                n, times = 0, times - 1
            keep(gap, times, content)
    return found + [p for held in bins.values() for p in held]


class Slots:
    """Where the pieces of each length go, by their number."""

    def __init__(self, patterns: list[Pattern], size: int):
        used: Counter[int] = Counter()
        rows, sequence = [], 0
        for times, content in patterns:
            offset = 0
            for length, copies in content:
                rows.append((length, used[length], copies, sequence, offset))
                used[length] += times * copies
                offset += length * copies
            sequence += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.first, self.copies, self.sequence, self.offset = table.T
        self.sequences = sequence
        # one sorted key for length and number
        self._span = max(used.values(), default=0) + 1
        self._key = self.length * self._span + self.first

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self._key, length * self._span + number, side="right") - 1
        turn = number - self.first[at]
        return self.sequence[at] + turn // self.copies[at], self.offset[at] + turn % self.copies[at] * length


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, piece (from 0), start, length, ids (unsigned 32-bit little-endian bytes), ids_crc32, sequence_id and offset: one
    row for each piece of a document's ids and the end id.

    Ids are those of the tokenizer library for the whole text, special strings read as it reads them by default, no special
    tokens added. Only documents of more than `size` ids are cut, every `size` ids. A null or empty text is the end id alone. Rows
    that repeat an id are documents of their own. Sequences are numbered from 0 and filled without gaps from offset 0; pieces
    of equal length are interchangeable. An empty table gives no rows.

    `size` counts reach the driver, and the plan that goes to the tasks has at most as many patterns as a small multiple of
    `size`, of at most sqrt(2 * size) lengths each. Pieces of one length are numbered by task, so a length that a third of all
    pieces share is no group of its own. A text is in one task, which needs memory for its ids.
    """
    made = cut(pieces(docs, tokenizer_path, size, end_id, id_col, text_col), "pieces")
    counts = made.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    held = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    slots = Slots(plan(held, size), size)
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = made.withColumn("ids_crc32", F.crc32("ids")).join(starts, ["length", "_task"]).withColumn("_number", F.col("_before") + F.col("_turn"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = slots.find(length.to_numpy(), number.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    found = numbered.withColumn("_place", place("length", "_number"))
    return found.select(id_col, "piece", "start", "length", "ids", "ids_crc32", "_place.sequence_id", "_place.offset")
