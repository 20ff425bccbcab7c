"""Token counts at every prefix of a text, by dynamic programming over the prefixes.

A merge tokenizer's result for a prefix ends in exactly one piece, and a row of pieces is the tokenizer's own result exactly
when every two neighbours are: the pair, tokenized by itself, gives the same two pieces. So the last piece of prefix i is the
one piece that ends there, is its own result, and goes with the last piece of the prefix before it; the count follows. The
counts of all prefixes answer where to cut a text for a budget, or what a cut costs, without encoding again.

No piece has the space mark after another character, so a text falls into independent segments (marks, then other characters).
Each Arrow batch finds its distinct segments and runs the programming for all of them together, position by position, with
numpy: a trie gives the pieces that start at a position, and a bounded cache the pairs that go together. Nothing is kept
between batches but that cache.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.words import blocks, mix

MARK = "▁"
_SEGMENT = re.compile("▁*[^▁]+|▁+")
#: bytes of text that a task looks at together
BLOCK_BYTES = 16 << 20


class PieceRules:
    """What the merges of a vocabulary allow. `scores`: piece -> score, higher merges first."""

    def __init__(self, scores: dict[str, float], byte_cost):
        self.byte_cost = byte_cost
        self.late = {piece: -score for piece, score in scores.items()}
        self._split: dict[str, tuple[str, str]] = {}
        self.pieces = [p for p in scores if len(p) == 1 or "".join(self._halves(p)) == p]
        self.id_of = {p: i for i, p in enumerate(self.pieces)}
        self.chars = sorted({c for p in self.pieces for c in p} & set(self.pieces))
        self.code_of = np.zeros(0x110000, np.int64)  # 0: no piece of its own
        self.code_of[[ord(c) for c in self.chars]] = np.arange(1, len(self.chars) + 1)
        self._build_trie()
        # a direct-mapped cache: pair -> allowed; a clash only costs looking at the pair again
        self._seen = np.full(1 << 20, -1, np.int64)
        self._allowed = np.zeros(1 << 20, bool)

    def merged(self, text: str, down_to: int = 1) -> list[str]:
        """Pieces of a short text by merging: the best score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > down_to:
            best, at = math.inf, -1
            for i in range(len(parts) - 1):
                late = self.late.get(parts[i] + parts[i + 1], math.inf)
                if late < best:
                    best, at = late, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, piece: str) -> tuple[str, ...]:
        """The two parts that the last merge within a piece joins; more if merging stops before."""
        if (known := self._split.get(piece)) is None:
            known = self._split[piece] = tuple(self.merged(piece, 2))
            if len(known) > 2:
                known = self._split[piece] = ("",)
        return known

    def goes(self, a: str, b: str) -> bool:
        """Whether merging leaves a and b apart: go back in time, undoing the later merge of the two at the border each time,
        and look whether what touched there would have merged before the merge just undone (of equals the left goes first)."""
        late = math.inf
        while True:
            if self.late.get(a + b, math.inf) < late:
                return False
            of_a, of_b = (self.late[a] if len(a) > 1 else -1), (self.late[b] if len(b) > 1 else -1)
            if of_a < 0 and of_b < 0:
                return True
            if of_a > of_b:
                late, a = of_a, self._halves(a)[1]
            else:
                late, b = of_b + 0.5, self._halves(b)[0]

    def goes_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`goes` for arrays of piece ids."""
        key = left.astype(np.int64) * len(self.pieces) + right
        slot = (mix(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        new = np.flatnonzero(self._seen[slot] != key)
        out = self._allowed[slot]
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            n = len(self.pieces)
            found = np.array([self.goes(self.pieces[k // n], self.pieces[k % n]) for k in keys.tolist()], bool)
            out[new] = found[back]
            self._seen[slot[new]] = key[new]
            # of several pairs in one slot the last stays, with its own answer
            self._allowed[slot[new]] = found[back]
        return out

    def _build_trie(self) -> None:
        nodes: dict[tuple[int, int], int] = {}
        piece_at = [-1]
        for piece, i in self.id_of.items():
            at = 0
            for code in self.code_of[[ord(c) for c in piece]].tolist():
                nxt = nodes.get((at, code))
                if nxt is None:
                    nxt = nodes[at, code] = len(piece_at)
                    piece_at.append(-1)
                at = nxt
            piece_at[at] = i
        width = len(self.chars) + 1
        edges = sorted((a * width + c, n) for (a, c), n in nodes.items())
        self._edges = np.array([e for e, _ in edges] + [np.iinfo(np.int64).max], np.int64)
        self._next = np.array([n for _, n in edges] + [0], np.int64)
        self.piece_at, self.longest = np.array(piece_at, np.int64), max(map(len, self.pieces), default=1)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Trie nodes reached; 0 where there is none."""
        key = node * (len(self.chars) + 1) + code
        at = np.searchsorted(self._edges, key)
        return np.where(self._edges[at] == key, self._next[at], 0)

    def prefix_counts(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, first): the counts of segment i's prefixes of 1, 2, ... code points are `counts[first[i]:first[i + 1]]`."""
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        first = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros(first[-1], np.int32)
        order = np.argsort(-size, kind="stable")
        lo = 0
        while lo < len(order):
            # about 2 million cells at a time, one segment at least
            hi = min(len(order), lo + max(1, 2_000_000 // int(size[order[lo]] + 1)))
            rows = order[lo:hi]
            own = size[rows]
            counts = self._program([segments[i] for i in rows.tolist()], own)
            width = np.arange(int(own[0]))
            inside = width[None, :] < own[:, None]
            out[(first[rows][:, None] + width[None, :])[inside]] = counts[:, 1:][inside]
            lo = hi
        return out, first

    def _program(self, segments: list[str], size: np.ndarray) -> np.ndarray:
        """Counts at prefixes 0, 1, ... for segments given longest first."""
        wide = int(size[0])
        points = np.zeros((len(segments), wide), np.uint32)
        points[np.arange(wide)[None, :] < size[:, None]] = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code_of[points]
        counts = np.zeros((len(segments), wide + 1), np.int32)
        last = np.full((len(segments), wide + 1), -1, np.int64)
        for j in range(wide):
            live = int(np.searchsorted(-size, -j))  # those longer than j
            odd = np.flatnonzero(codes[:live, j] == 0)
            if len(odd):
                counts[odd, j + 1] = counts[odd, j] + np.array([self.byte_cost(chr(c)) for c in points[odd, j].tolist()], np.int32)
            rows = np.flatnonzero(codes[:live, j])
            node = np.zeros(len(rows), np.int64)
            for k in range(j, min(wide, j + self.longest)):
                node = self.step(node, codes[rows, k])
                kept = node > 0
                rows, node = rows[kept], node[kept]
                if not len(rows):
                    break
                piece = self.piece_at[node]
                ends = np.flatnonzero(piece >= 0)
                if len(ends):
                    at, new = rows[ends], piece[ends]
                    before = last[at, j]
                    fine = before < 0
                    inner = np.flatnonzero(~fine)
                    fine[inner] = self.goes_all(before[inner], new[inner])
                    at, new = at[fine], new[fine]
                    counts[at, k + 1] = counts[at, j] + 1
                    last[at, k + 1] = new
        return counts


@functools.lru_cache(2)
def piece_rules(path: str) -> PieceRules:
    """Scores of the mergeable pieces of a sentencepiece model and the cost of characters outside it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    scores = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))}
    bytes_too = any(model.is_byte(i) for i in ids)
    return PieceRules(scores, (lambda c: len(c.encode())) if bytes_too else (lambda c: 1))


def segments(text: str) -> list[str]:
    """Independent parts of a text that has code points: the leading mark that the tokenizer adds is in the first."""
    marked = text.replace(" ", MARK)
    parts = marked.split(MARK)
    if parts[0] and "" not in parts:
        return [MARK + p for p in parts]
    return _SEGMENT.findall(MARK + marked)


class BatchCounts:
    """Prefix counts of the texts of one batch, from those of its distinct segments."""

    def __init__(self, texts: list[str], rules: PieceRules):
        known: dict[str, int] = {}
        parts = [[known.setdefault(s, len(known)) for s in segments(t)] if t else [] for t in texts]
        self.own = [np.array(p, np.int64) for p in parts]
        self.counts, self.first = rules.prefix_counts(list(known))
        total = self.counts[self.first[1:] - 1] if len(known) else np.zeros(0, np.int32)
        self.totals = [int(total[p].sum(dtype=np.int64)) if len(p) else 0 for p in self.own]
        self._total = total

    def at_each(self, i: int) -> np.ndarray:
        """Exact tokens of the prefixes of 0, 1, ... code points of text i."""
        parts = self.own[i]
        if not len(parts):
            return np.zeros(1, np.int64)
        size = self.first[parts + 1] - self.first[parts]
        start = np.cumsum(size) - size
        cells = np.arange(size.sum()) - np.repeat(start, size) + np.repeat(self.first[parts], size)
        before = np.cumsum(self._total[parts], dtype=np.int64) - self._total[parts]
        found = self.counts[cells] + np.repeat(before, size)
        found[0] = 0  # the mark that the tokenizer adds: the empty prefix
        return found


def count_tokens(docs: DataFrame, model: str, limits: tuple[int, ...] = (), table: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact token counts of whole texts: id, n_chars, n_bytes, n_tokens; for every limit `fit_<limit>`, the code points of the
    longest prefix within it (a longer prefix may again cost less; this is the longest that fits); with `table` also `steps`:
    a signed byte for each code point, by which the count moves there, so their running sum is the count at every prefix.

    A null text counts as empty: 0 tokens. Ids are carried, never interpreted: null and repeated ids give a row each. Other
    columns are left out. An empty table gives an empty result.
    """
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
        + [T.StructField(f"fit_{n}", T.LongType()) for n in limits]
        + ([T.StructField("steps", T.BinaryType())] if table else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = piece_rules(model)
        for batch in blocks(batches, "text", BLOCK_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = BatchCounts(texts, rules)
            # no prefix costs more than the whole unless the whole is over the limit too, or fits as it is
            fits = {n: [len(t) if total <= n else int(np.flatnonzero(found.at_each(i) <= n)[-1]) for i, (t, total) in enumerate(zip(texts, found.totals, strict=True))] for n in limits}
            columns = [batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(found.totals, pa.int64())]
            columns += [pa.array(fits[n], pa.int64()) for n in limits]
            if table:
                columns.append(pa.array([np.diff(found.at_each(i)).astype(np.int8).tobytes() for i in range(len(texts))], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def tokens_before(steps: Column, offset: Column) -> Column:
    """Exact tokens of the first `offset` code points, from the stored table."""

    @F.pandas_udf("long")
    def before(tables, offsets):
        import pandas as pd

        return pd.Series([None if t is None or n is None or n != n else int(np.frombuffer(t[: max(0, int(n))], np.int8).sum(dtype=np.int64)) for t, n in zip(tables, offsets, strict=True)], dtype="Int64")

    return before(steps, offset)
