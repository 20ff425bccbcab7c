"""Repeated word windows across a corpus, found by recompression.

Texts are rewritten in rounds: a run of one symbol becomes one symbol, then every symbol of a left class followed by one of a
right class becomes one symbol with it. A symbol's name is a hash of its parts and classes are a bit of the name, so all tasks
name equal runs and pairs alike without a shared dictionary. Symbols of `FULL` words stay as they are. Equal substrings are
rewritten alike except near their ends; for every symbol the words are kept that decide it (its context), so "a window that
holds a symbol's context holds that symbol, wherever the window stands" is exact.

Spark then counts the symbols' names over all texts. A window with a symbol that is met once cannot repeat. What is left are
the windows inside or around real repeats; each gets a 128-bit name of its words, and those names are counted over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import packets
from barloom.llm.store import cut, drop
from barloom.llm.words import Words, blocks, combine, mix

#: a symbol of so many words takes no part in later rounds
FULL = 8
#: symbols of fewer words are too common to tell anything
LEAST = 4
ROUNDS = 10
BLOCK_BYTES = 8 << 20
#: bucket of finished documents
DONE = -2
_FAR = 1 << 40


def symbols(names: np.ndarray, head: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, words, from, to) of the last round's symbols over all texts; the context is the words `from:to`, and reaches
    beyond any text where the text's end takes part in the decision. `head` marks the first word of each text."""
    word, n = names, len(names)
    name, start, end = names.copy(), np.arange(n), np.arange(1, n + 1)
    lo, hi = start.copy(), end.copy()
    tail = np.ones(n, bool)
    tail[:-1] = head[1:]
    for r in range(rounds):
        if len(name) < 2:
            break
        # runs; a neighbour that differs in the word next to the border differs, else its name has to be known
        live = end - start < FULL
        same = np.zeros(len(name), bool)
        same[1:] = (name[1:] == name[:-1]) & ~head[1:] & live[1:] & live[:-1]
        at = np.flatnonzero(~same)
        stop = np.append(at[1:], len(name)) - 1
        size = stop - at + 1
        run_lo, run_hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
        moved = live[at]
        left, right = np.maximum(at - 1, 0), np.minimum(stop + 1, len(name) - 1)
        differs = word[np.maximum(start[at] - 1, 0)] != word[end[at] - 1]
        edge = head[at]
        by_name = moved & ~edge & ~differs
        new_lo = np.where(moved & edge, -_FAR, np.where(moved & differs, np.minimum(run_lo, start[at] - 1), run_lo))
        new_lo[by_name] = np.minimum(run_lo, lo[left])[by_name]
        new_hi = run_hi.copy()
        new_hi[by_name] = np.maximum(run_hi, hi[left])[by_name]
        differs = word[np.minimum(end[stop], n - 1)] != word[start[stop]]
        edge = tail[stop]
        by_name = moved & ~edge & ~differs
        new_hi = np.where(moved & edge, _FAR, np.where(moved & ~edge & differs, np.maximum(new_hi, end[stop] + 1), new_hi))
        new_hi[by_name] = np.maximum(new_hi, hi[right])[by_name]
        new_lo[by_name] = np.minimum(new_lo, lo[right])[by_name]
        named = name[at]
        several = size > 1
        named[several] = combine(named[several], mix(size[several].astype(np.uint64)))
        name, start, end, lo, hi, head, tail = named, start[at], end[stop], new_lo, new_hi, head[at], tail[stop]

        # pairs; one left alone is so because of its neighbour
        live = end - start < FULL
        second = (mix(name ^ np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(63)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = live[:-1] & ~second[:-1] & live[1:] & second[1:] & ~head[1:]
        taken = np.zeros(len(name), bool)
        taken[1:] = pair[:-1]
        alone = live & ~pair & ~taken
        new_lo, new_hi = lo.copy(), hi.copy()
        i = np.flatnonzero(alone & ~second & tail)
        new_hi[i] = _FAR
        i = np.flatnonzero(alone & ~second & ~tail)
        new_lo[i], new_hi[i] = np.minimum(lo[i], lo[i + 1]), np.maximum(hi[i], hi[i + 1])
        i = np.flatnonzero(alone & second & head)
        new_lo[i] = -_FAR
        i = np.flatnonzero(alone & second & ~head)
        new_lo[i], new_hi[i] = np.minimum(lo[i], lo[i - 1]), np.maximum(hi[i], hi[i - 1])
        i = np.flatnonzero(pair)
        new_lo[i], new_hi[i] = np.minimum(lo[i], lo[i + 1]), np.maximum(hi[i], hi[i + 1])
        name[i] = combine(name[i], name[i + 1])
        end, tail = end.copy(), tail.copy()
        end[i], tail[i] = end[i + 1], tail[i + 1]
        kept = ~taken
        name, start, end, lo, hi, head, tail = name[kept], start[kept], end[kept], new_lo[kept], new_hi[kept], head[kept], tail[kept]
    return name, end - start, lo, hi


class _Parse:
    """A batch's texts, the symbols that can tell its windows apart, and the names of its windows."""

    def __init__(self, texts: pa.Array, window: int):
        self.words, self.window = Words(texts), window
        self.name = self.words.names()
        n = len(self.name)
        self.sizes = np.diff(self.words.first)
        head = np.zeros(n, bool)
        head[self.words.first[:-1][self.sizes > 0]] = True
        name, size, lo, hi = symbols(self.name, head)
        telling = (size >= LEAST) & (hi - lo <= window)
        self.symbols, self.lo, self.hi = name[telling], lo[telling], hi[telling]

    def windows(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows all of whose symbols are repeated ones."""
        n = len(self.name)
        once = ~repeated
        change = np.zeros(n + 2, np.int32)
        np.add.at(change, np.maximum(self.hi[once] - self.window, 0), 1)
        np.add.at(change, self.lo[once] + 1, -1)
        open_ = np.cumsum(change[:n]) <= 0
        inside = np.zeros(n + 1, np.int32)
        long_ = self.sizes >= self.window
        np.add.at(inside, self.words.first[:-1][long_], 1)
        np.add.at(inside, self.words.first[1:][long_] - self.window + 1, -1)
        return np.flatnonzero(open_ & (np.cumsum(inside[:n]) > 0))

    def window_names(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit names of the windows that start there, by doubling."""
        out = []
        for word in (self.name, self.words.names(1)):
            size = 1
            while size * 2 <= self.window:
                word = combine(word[: len(word) - size], word[size:])
                size *= 2
            out.append(combine(word[starts], word[starts + self.window - size]))
        return out[0], out[1]


class _Distinct:
    """Distinct keys (one or two lanes) in order, and how to get back to the rows."""

    def __init__(self, *lanes: np.ndarray):
        order = np.lexsort(lanes[::-1])
        self.rows = len(order)
        new = np.ones(self.rows, bool)
        if self.rows:
            new[1:] = False
            for lane in lanes:
                own = lane[order]
                new[1:] |= own[1:] != own[:-1]
        number = np.cumsum(new) - 1
        self.of_row = np.empty(self.rows, np.int64)
        self.of_row[order] = number
        self.keys = [lane[order][new] for lane in lanes]
        self.several = np.bincount(number, minlength=len(self.keys[0])) > 1

    def packets(self, batch: int, buckets: int) -> list[tuple[int, int, bytes]]:
        raw = np.stack(self.keys, axis=1) if len(self.keys[0]) else np.zeros((0, len(self.keys)), np.uint64)
        return [(batch, b, packets.pack_parts(raw[lo:hi].tobytes(), np.packbits(self.several[lo:hi]).tobytes())) for b, lo, hi in packets.slices(self.keys[0], buckets)]

    def flags(self, answers: dict[int, bytes], buckets: int) -> np.ndarray:
        """Per row: whether its key is repeated, from the buckets' answers."""
        found = np.zeros(len(self.keys[0]), bool)
        for b, lo, hi in packets.slices(self.keys[0], buckets):
            found[lo:hi] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=hi - lo).astype(bool)
        return found[self.of_row]


def _repeated(lanes: int):
    """Answers the packets of one bucket: a bit for each key, set where the key has another occurrence anywhere."""

    def answer(group: pa.Table) -> pa.Table:
        batches, buckets = group["batch"].to_pylist(), group["bucket"].to_pylist()
        parts = [packets.unpack_parts(p) for p in group["payload"].to_pylist()]
        keys = [np.frombuffer(k, np.uint64).reshape(-1, lanes) for k, _ in parts]
        several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)) for k, (_, b) in zip(keys, parts, strict=True)]).astype(bool)
        every = np.concatenate(keys)
        met = _Distinct(*[np.ascontiguousarray(every[:, i]) for i in range(lanes)])
        again = met.several.copy()
        np.logical_or.at(again, met.of_row, several)
        flags, out, at = again[met.of_row], [], 0
        for batch, bucket, own in zip(batches, buckets, keys, strict=True):
            out.append((batch, bucket, np.packbits(flags[at : at + len(own)]).tobytes()))
            at += len(own)
        return pa.Table.from_batches([packets.rows(out)])

    return answer


def _answers(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True))


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the words covered by a window of `window` words that also starts anywhere else, same text included:
    id, n_words, n_removed, kept (the words left, joined by one space).

    Words are runs of `[^\\x20\\x09-\\x0D]`. A null text has none. Texts shorter than the window stay whole. Repeated rows are
    texts like others, so their windows repeat. Ids are carried, never interpreted. Other columns are left out.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = packets.buckets_for(slim)

    def name_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = packets.batch_ids()
        for batch in blocks(batches, "text", BLOCK_BYTES):
            own = next(ids)
            keys = _Distinct(_Parse(batch.column("text"), window).symbols)
            yield packets.rows([(own, packets.DOCS, packets.pack_table(batch)), *keys.packets(own, buckets)])

    named = cut(slim.mapInArrow(name_symbols, packets.SCHEMA), "symbols")
    repeated_symbols = named.where(F.col("bucket") >= 0).groupBy("bucket").applyInArrow(_repeated(1), packets.SCHEMA)

    def name_windows(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for own, payload in zip(rows["batch"].to_pylist(), rows["payload"].to_pylist(), strict=True):
            table = packets.unpack_table(payload)
            parse = _Parse(table.column("text"), window)
            starts = parse.windows(_Distinct(parse.symbols).flags(_answers(answers), buckets))
            text_of = np.searchsorted(parse.words.first, starts, side="right") - 1
            touched = np.bincount(text_of, minlength=table.num_rows) > 0
            if not touched.all():
                out.append((own, DONE, packets.pack_table(table.filter(pa.array(~touched)))))
            if touched.any():
                # the starts are counted from the first word of the texts that go on
                before = np.cumsum(np.where(touched, 0, parse.sizes)) - np.where(touched, 0, parse.sizes)
                marks = packets.pack_ints(starts - before[text_of])
                out.append((own, packets.DOCS, packets.pack_parts(packets.pack_table(table.filter(pa.array(touched))), marks)))
                out += _Distinct(*parse.window_names(starts)).packets(own, buckets)
        return pa.Table.from_batches([packets.rows(out)])

    with_docs = named.where(F.col("bucket") == packets.DOCS).groupBy("batch")
    windows = cut(with_docs.cogroup(repeated_symbols.groupBy("batch")).applyInArrow(name_windows, packets.SCHEMA), "windows")
    drop(named)
    repeated_windows = windows.where(F.col("bucket") >= 0).groupBy("bucket").applyInArrow(_repeated(2), packets.SCHEMA)

    schema = T.StructType([T.StructField("id", slim.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def result(table: pa.RecordBatch, gone: list[np.ndarray | None]) -> pa.RecordBatch:
        kept, n_words, n_removed = [], [], []
        for text, out in zip(table.column("text").to_pylist(), gone, strict=True):
            words = (text or "").encode().split()
            n_words.append(len(words))
            n_removed.append(0 if out is None else int(out.sum()))
            kept.append(b" ".join(words if out is None else compress(words, ~out)).decode())
        return pa.RecordBatch.from_arrays([table.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    def take_out(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for payload in rows["payload"].to_pylist():
            table, marks = packets.unpack_parts(payload)
            table, starts = packets.unpack_table(table), packets.unpack_ints(marks).astype(np.int64)
            parse = _Parse.__new__(_Parse)
            parse.words, parse.window = Words(table.column("text")), window
            parse.name = parse.words.names()
            again = starts[_Distinct(*parse.window_names(starts)).flags(_answers(answers), buckets)]
            change = np.zeros(len(parse.name) + 1, np.int32)
            np.add.at(change, again, 1)
            np.add.at(change, again + window, -1)
            covered, first = np.cumsum(change[:-1]) > 0, parse.words.first
            out.append(result(table, [covered[a:b] if covered[a:b].any() else None for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]))
        return pa.Table.from_batches(out)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                table = packets.unpack_table(payload)
                yield result(table, [None] * table.num_rows)

    changed = windows.where(F.col("bucket") == packets.DOCS).groupBy("batch").cogroup(repeated_windows.groupBy("batch")).applyInArrow(take_out, schema)
    same = windows.where(F.col("bucket") == DONE).mapInArrow(untouched, schema)
    return changed.unionAll(same).withColumnRenamed("id", id_col)
