"""Language by cross-parsing: how few phrases of a labelled text does it take to spell out a document?

For every language a suffix automaton of a bounded sample of labelled text finds the longest match from any place. Reading a
document greedily, a new phrase begins where the match cannot be extended; phrases times the logarithm of the sample's length,
over the document's length, estimate the cross entropy. The language with the least wins.

The automata are arrays, so that all documents of a batch are read in step, one letter each at a time.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.words import blocks
from barloom.llm.workers import released

#: letters of labelled text for all languages together: the bound of the model's size
SAMPLE_LETTERS = 200_000
#: labelled documents of a language to take them from, and code points of each
SAMPLE_DOCS, SAMPLE_POINTS = 64, 2_000
#: rows that pass the bound of a language, as a multiple of those wanted
LIKELY = 4
#: letters read without a break; a longer text is read in parts, each beginning a phrase
PART = 512
BLOCK_BYTES = 1 << 20
UNKNOWN = "und"


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-case texts with each stretch of other characters as one 0, and the texts' edges."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))])
    points = np.where(_letters()[points], points, 0)
    again = np.zeros(len(points), bool)
    again[1:] = (points[1:] == 0) & (points[:-1] == 0)
    first = edges[:-1][edges[:-1] < len(points)]
    again[first] = points[first] == 0
    kept = ~again
    return points[kept], np.concatenate([[0], np.cumsum(kept)])[edges]


class Automaton:
    """Suffix automaton of a sequence of letters below `width`, and the greedy reading.

    Only the moves that a state has are kept: those of all states lie in one array, each state's from its own base on, in slots
    that no other state uses, so that the size follows the sequence and not the alphabet. A letter without a move begins a
    phrase; one that the sequence lacks is a phrase by itself and leads to the last state, which stands before every phrase.
    """

    def __init__(self, codes: list[int], width: int):
        links, longest, moves = [-1], [0], [{}]
        last = 0
        for code in codes:
            new = len(links)
            links.append(0), longest.append(longest[last] + 1), moves.append({})
            at = last
            while at >= 0 and code not in moves[at]:
                moves[at][code] = new
                at = links[at]
            if at >= 0:
                to = moves[at][code]
                if longest[to] == longest[at] + 1:
                    links[new] = to
                else:
                    # the match ends in the middle of `to`: give it a state of its own
                    twin = len(links)
                    links.append(links[to]), longest.append(longest[at] + 1), moves.append(dict(moves[to]))
                    while at >= 0 and moves[at].get(code) == to:
                        moves[at][code] = twin
                        at = links[at]
                    links[to] = links[new] = twin
            last = new
        self.outside = len(links)
        self.restart = np.full(width, self.outside, np.int32)
        for code, to in moves[0].items():
            self.restart[code] = to
        self._place(moves, width)

    def _place(self, moves: list[dict[int, int]], width: int) -> None:
        rng = np.random.default_rng(5)
        # twice the moves, and room for the longest of them anywhere
        slots = 2 * sum(map(len, moves)) + 2 * width
        # a letter may be looked up on either side of a state's own slots
        self.check, self.move = np.full(slots + 2 * width, -1, np.int32), np.zeros(slots + 2 * width, np.int32)
        self.base = np.zeros(self.outside + 1, np.int32)
        taken = self.check >= 0
        taken[:width] = taken[width + slots :] = True
        several = sorted((s for s, own in enumerate(moves) if len(own) > 1), key=lambda s: -len(moves[s]))
        for state in several:
            codes = np.fromiter(moves[state], np.int64)
            first = int(codes.min())
            found = None
            while found is None:
                bases = rng.integers(width, width + slots, 32) - first
                bases = bases[bases + int(codes.max()) < width + slots]
                free = np.flatnonzero(~taken[bases[:, None] + codes].any(axis=1))
                if len(free):
                    found = int(bases[free[0]])
            self.base[state] = found
            at = found + codes
            taken[at] = True
            self.check[at], self.move[at] = state, np.fromiter(moves[state].values(), np.int64)
        lone = np.array([s for s, own in enumerate(moves) if len(own) == 1], np.int64)
        codes = np.array([next(iter(moves[s])) for s in lone.tolist()], np.int64)
        at = np.flatnonzero(~taken)[: len(lone)]
        self.base[lone], self.check[at] = at - codes, lone
        self.move[at] = [next(iter(moves[s].values())) for s in lone.tolist()]

    def read(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and where the match goes on without a new phrase."""
        at = self.base[state] + codes
        goes_on = self.check[at] == state
        return np.where(goes_on, self.move[at], self.restart[codes]), goes_on


class CrossParser:
    """The automata of all languages, and the reading."""

    def __init__(self, samples: dict[str, str], letters: int):
        self.languages = sorted(samples)
        each = letters // max(1, len(samples))
        own = [_points([samples[name]])[0][:each] for name in self.languages]
        known = np.unique(np.concatenate([*own, np.zeros(1, np.uint32)]))
        self.width = len(known) + 1  # the last code: letters that no sample has
        # letters beyond the last known one share its place behind the table
        self.code_of = np.full(int(known.max()) + 2, self.width - 1, np.int32)
        self.code_of[known] = np.arange(len(known))
        self.automata = [Automaton(self.code_of[x].tolist(), self.width) for x in own]
        self.bits = [np.log2(max(2, len(x))) for x in own]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits a letter in each language, whether the text has a letter) for every text."""
        points, edges = _points(texts)
        size = np.diff(edges)
        spelled = np.concatenate([[0], np.cumsum(points != 0)])[edges]
        codes = self.code_of[np.minimum(points, len(self.code_of) - 1)]
        parts = -(-size // PART)
        owner = np.repeat(np.arange(len(texts)), parts)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = edges[:-1][owner] + at * PART
        length = np.minimum(edges[1:][owner] - start, PART)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        out = np.zeros((len(texts), len(self.languages)))
        if len(owner):
            live = np.searchsorted(-length, -np.arange(int(length[0])))
            steps = [codes[start[:n] + t] for t, n in enumerate(live.tolist())]
            for k, automaton in enumerate(self.automata):
                state = np.full(len(owner), automaton.outside, np.int32)
                going = np.zeros(len(owner), np.int64)
                for own in steps:
                    n = len(own)
                    state[:n], on = automaton.read(state[:n], own)
                    going[:n] += on
                phrases = length - going
                out[:, k] = np.bincount(owner, phrases, len(texts)) * self.bits[k] / np.maximum(size, 1)
        return out, np.diff(spelled) > 0

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        bits, any_letter = self.entropies(texts)
        for own, some in zip(bits, any_letter, strict=True):
            if not some or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            order = np.argsort(own, kind="stable")
            names.append(self.languages[order[0]])
            scores.append(1.0 if len(own) == 1 else float(1 - own[order[0]] / own[order[1]]))
        return names, scores


def held_out(key: str) -> Column:
    """Documents that no sample may come from: a quarter, by the key's checksum."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def samples(docs: DataFrame, key: str = "doc_id", text_col: str = "text", lang_col: str = "lang", letters: int = SAMPLE_LETTERS) -> tuple[tuple[str, str], ...]:
    """Labelled text of each language, at most SAMPLE_DOCS pieces each, from documents that are not held out: those with the
    least hashes. Languages are counted first, so that about LIKELY times as many rows as are wanted pass a bound on their hash
    and only those are shuffled, whatever the size of the table; a language of which too few pass, as when most of its rows are
    equal, is searched again without the bound."""
    spark = docs.sparkSession
    named = docs.where(~held_out(key) & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(key).alias("key"), F.col(text_col).cast("string").alias("text"))
    counts = {r[0]: r[1] for r in named.groupBy("lang").count().collect()}
    if not counts:
        return ()
    start = F.substring("text", 1, SAMPLE_POINTS)
    learn = named.where(F.col("text").isNotNull()).select("lang", start.alias("text"), F.xxhash64("key", start).alias("h"))

    def least(rows: DataFrame) -> list:
        distinct = rows.groupBy("lang", "h").agg(F.min("text").alias("text"))
        best = distinct.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= SAMPLE_DOCS)
        return best.select("lang", "h", "text").orderBy("lang", "h").collect()

    shares = spark.createDataFrame([(name, min(2**63 - 1, -(2**63) + int(min(1.0, LIKELY * SAMPLE_DOCS / n) * 2**64))) for name, n in counts.items()], "lang string, most long")
    rows = least(learn.join(F.broadcast(shares), "lang").where(F.col("h") <= F.col("most")).select("lang", "text", "h"))
    met = Counter(r.lang for r in rows)
    again = [name for name, n in counts.items() if met[name] < min(SAMPLE_DOCS, n) and LIKELY * SAMPLE_DOCS < n]
    if again:
        rows = [r for r in rows if r.lang not in again] + least(learn.where(F.col("lang").isin(again)))
    found: dict[str, list[str]] = {}
    for row in rows:
        found.setdefault(row.lang, []).append(row.text)
    each = letters // max(1, len(found))
    return tuple(sorted((name, "\n".join(texts)[: 4 * each]) for name, texts in found.items()))


def identify(docs: DataFrame, labelled: tuple[tuple[str, str], ...], letters: int = SAMPLE_LETTERS, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (0 to 1: how far the best language is ahead of the second).

    Only the text is looked at, all of it. `und` with score 0: null, without a letter, or no language learned. Columns of
    `docs` that have the two names are replaced; others, null or repeated, are carried.
    """
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    # a few bytes for each letter of the samples, built once and sent to the tasks
    parser = CrossParser(dict(labelled), letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col, BLOCK_BYTES):
            names, scores = parser.predict([t or "" for t in batch.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*columns).mapInArrow(released(run), schema)
