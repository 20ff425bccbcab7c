"""Personal data and the terms that give it away.

Patterns find the personal data itself. Each value found is a protected entity; the corpus tells how much a term reveals of it:
the pointwise mutual information of term and entity, log(p(e, t) / (p(e) p(t))), against the information of the entity itself,
-log p(e). A term that reveals at least the share `alpha` of it is generalised to its class (number, name, word) if the class
reveals less than that, and removed if not. Probabilities are shares of documents, counted over the whole corpus.

A document holds a term wherever it stands in it outside the personal data, and `support` documents must hold both: what is met
once tells nothing about the corpus. A term that reveals an entity is replaced wherever it stands, in any document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.store import cut, drop
from barloom.llm.words import LOWER, MARKS, Words, blocks
from barloom.llm.workers import released

BLOCK_BYTES = 2 << 20
#: fixed values: kinds in the order of reports
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
CLASSES = ("number", "name", "word")
#: what is counted: documents, and those that hold a term, an entity or a term of a class
_DOC, _TERMS, _ENTITY, _CLASS = range(4)
#: pairs of entity and term that a task adds up at a time
PAIRS = 1 << 20
#: bits of a filter over names, and where a name's own bits are read from it
FILTER_BITS, _SHIFTS = 1 << 25, (0, 19, 39)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its start fails from everywhere in it
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")
_DIGIT = re.compile("[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, each @ looked at once."""
    out, after = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and not _NOT_LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            after = m.end()
        else:
            # what is left of a failed @ cannot belong to a later one, as no name holds an @
            after = at + 1
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: by kind, then start. A match that fails its test is dropped."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def class_of(term: str) -> str:
    return CLASSES[0] if _DIGIT.search(term) else CLASSES[1] if term[:1].isupper() else CLASSES[2]


def _name(kind: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}:{value}".encode()) - (1 << 63)


def _blank(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with blanks for the spans and the terms that reach into them: as long as before."""
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if _TERM.match(text, a):
            while a > at and _TERM.match(text[a - 1]):
                a -= 1
        if _TERM.match(text[b - 1]) and (m := _TERM.match(text, b)):
            b = m.end()
        if b > at:
            out += [text[at:a], " " * (b - max(a, at))]
            at = b
    return "".join([*out, text[at:]])


def _classes(words: Words) -> np.ndarray:
    """`class_of` each word, as its place in CLASSES."""
    raw = words._raw
    digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57), dtype=np.int32)])
    first = raw[words.starts]
    upper = (first >= 65) & (first <= 90)
    wide = np.flatnonzero(first >= 128)
    if len(wide):
        size = np.where(first[wide] < 0xE0, 2, np.where(first[wide] < 0xF0, 3, 4))
        padded = np.concatenate([raw, np.zeros(4, np.uint8)])
        letter = padded[words.starts[wide][:, None] + np.arange(4)]
        letter[np.arange(4) >= size[:, None]] = 0
        codes, at = np.unique(np.ascontiguousarray(letter).view("<u4").ravel(), return_inverse=True)
        upper[wide] = np.array([c.tobytes().rstrip(b"\0").decode().isupper() for c in codes])[at]
    return np.where(digits[words.ends] > digits[words.starts], 0, np.where(upper, 1, 2))


class _Block:
    """The personal data of several texts, and their terms outside it: names of the terms in lower case, and classes."""

    def __init__(self, column: pa.Array):
        self.texts = [t or "" for t in column.to_pylist()]
        self.found = [find(t) for t in self.texts]
        self.blank = pa.array([_blank(t, f) if f else t for t, f in zip(self.texts, self.found, strict=True)], pa.large_string())

    def entities(self, i: int) -> np.ndarray:
        return np.unique(np.array([_name(kind, self.texts[i][a:b]) for kind, a, b in self.found[i]], np.int64))

    def terms(self, rows: list[int] | None = None) -> Words:
        words = Words(self.blank if rows is None else self.blank.take(pa.array(rows, pa.int64())), MARKS)
        words.classes = _classes(words)
        words.bytes, words._raw = words._raw, LOWER[words._raw]
        words.called = words.names().view(np.int64)
        return words


def _parts(words: Words) -> Iterator[slice]:
    return (slice(a, b) for a, b in zip(words.first.tolist(), words.first[1:].tolist(), strict=False))


def counted(docs: DataFrame, text_col: str) -> DataFrame:
    """kind, name, n: all documents, and those that hold each term, entity and class, added up per batch before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col, BLOCK_BYTES):
            block = _Block(batch.column(text_col))
            words = block.terms()
            once = {
                _DOC: [np.zeros(batch.num_rows, np.int64)],
                _TERMS: [np.unique(words.called[part]) for part in _parts(words)],
                _ENTITY: [block.entities(i) for i, f in enumerate(block.found) if f],
                _CLASS: [np.unique(words.classes[part]) for part in _parts(words)],
            }
            for kind, names in once.items():
                name, n = np.unique(np.concatenate([*names, np.zeros(0, np.int64)]).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(name), kind), pa.int32()), pa.array(name, pa.int64()), pa.array(n, pa.int64())], names=["kind", "name", "n"])

    return docs.select(text_col).mapInArrow(released(run), "kind int, name long, n long").groupBy("kind", "name").agg(F.sum("n").alias("n"))


def together(docs: DataFrame, text_col: str, asked: np.ndarray) -> DataFrame:
    """entity, kind (term or class), name, n_both: documents that hold both, wherever in the text, for the entities that pass the
    filter; added up per batch, a bounded number of pairs at a time, before they are shuffled."""

    def added(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        entity, kind, name = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((name, kind, entity))
        entity, kind, name = entity[order], kind[order], name[order]
        new = np.ones(len(name), bool)
        new[1:] = (entity[1:] != entity[:-1]) | (kind[1:] != kind[:-1]) | (name[1:] != name[:-1])
        at = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([pa.array(entity[at], pa.int64()), pa.array(kind[at], pa.int32()), pa.array(name[at], pa.int64()), pa.array(np.diff(np.append(at, len(name))), pa.int64())], names=["entity", "kind", "name", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in blocks(batches, text_col, BLOCK_BYTES):
            block = _Block(batch.column(text_col))
            named = {i: block.entities(i) for i, f in enumerate(block.found) if f}
            protected = {i: e[_passes(asked, e)] for i, e in named.items() if _passes(asked, e).any()}
            if not protected:
                continue
            words = block.terms(list(protected))
            for entities, part in zip(protected.values(), _parts(words), strict=True):
                terms, classes = np.unique(words.called[part]), np.unique(words.classes[part]).astype(np.int64)
                names = np.concatenate([terms, classes])
                kinds = np.repeat(np.array([_TERMS, _CLASS], np.int32), [len(terms), len(classes)])
                step = max(1, PAIRS // max(1, len(names)))
                for lo in range(0, len(entities), step):
                    own = entities[lo : lo + step]
                    held.append((np.repeat(own, len(names)), np.tile(kinds, len(own)), np.tile(names, len(own))))
                    size += len(own) * len(names)
                    if size >= PAIRS:
                        yield added(held)
                        held, size = [], 0
        if held:
            yield added(held)

    return docs.select(text_col).mapInArrow(released(run), "entity long, kind int, name long, n long").groupBy("entity", "kind", "name").agg(F.sum("n").alias("n_both"))


def _bits(name: np.ndarray, shift: int) -> np.ndarray:
    return ((name.view(np.uint64) >> np.uint64(shift)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _filter(names: DataFrame) -> np.ndarray:
    """A Bloom filter of the column `name`, of one size however many there are: lets all of them pass, and few others."""
    bit = F.explode(F.array(*[F.shiftrightunsigned("name", s).bitwiseAND(F.lit(FILTER_BITS - 1).cast("long")) for s in _SHIFTS]))
    found = names.select(bit.alias("bit")).groupBy(F.expr("cast(shiftright(bit, 6) as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _passes(wanted: np.ndarray, name: np.ndarray) -> np.ndarray:
    out = np.ones(len(name), bool)
    for shift in _SHIFTS:
        bit = _bits(name, shift)
        out &= (wanted[bit >> 6] >> (bit & 63)) & 1 == 1
    return out


MAYBE = T.ArrayType(T.StructType([T.StructField("name", T.LongType()), T.StructField("class", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def detect(docs: DataFrame, text_col: str, keep: list[str], wanted: np.ndarray) -> DataFrame:
    """The columns in `keep`, row (a number of its own), base spans, and every term that passes the filter, wherever it stands."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("_row", T.LongType()), T.StructField("_base", SPANS), T.StructField("_maybe", MAYBE)])
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in blocks(batches, text_col, BLOCK_BYTES):
            block = _Block(batch.column(text_col))
            base = [[{"kind": k, "start": a, "end": b} for k, a, b in found] for found in block.found]
            words = block.terms()
            at = np.flatnonzero(_passes(wanted, words.called))
            # bytes to code points, counted from the start of each text
            points = np.concatenate([[0], np.cumsum((words.bytes & 0xC0) != 0x80, dtype=np.int32)])
            text = np.searchsorted(words.first, at, side="right") - 1
            sizes = pc.binary_length(block.blank).to_numpy(zero_copy_only=False)
            origin = points[np.concatenate([[0], np.cumsum(sizes)])[text].astype(np.int64)]
            maybe = pa.StructArray.from_arrays(
                [pa.array(words.called[at], pa.int64()), pa.array(words.classes[at], pa.int32()), pa.array(points[words.starts[at]] - origin, pa.int32()), pa.array(points[words.ends[at]] - origin, pa.int32())], names=["name", "class", "start", "end"]
            )
            maybe = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, words.first), pa.int32()), maybe)
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], rows, pa.array(base, span_type), maybe], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(released(run), schema)


def _share(together: str, term: str, entity: str, total: Column) -> Column:
    """What a term tells of an entity, as a share of what there is to know: PMI over the entity's information."""
    pmi = F.log(total * F.col(together) / (F.col(term) * F.col(entity)))
    information = F.log(total / F.col(entity))
    return F.when(information > 0, pmi / information).otherwise(F.lit(0.0))


def sanitise(docs: DataFrame, alpha: float = 0.9, support: int = 2, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns in `keep` (all by default) with spans: an array of (kind, start, end, how) by kind as in KINDS, `term` last, then
    start; offsets are code points, end exclusive; how is `value`, `general` or `remove`. `redact` makes texts of it.

    A null text counts as empty and has no spans. Repeated rows are documents of their own and count as such. An entity that every
    document holds tells nothing and protects nothing. `spans` replaces a column of that name. `docs` is read three times.
    """
    text = F.col(text_col).cast("string")
    names = [c for c in (docs.columns if keep is None else keep) if c != "spans"]
    docs = docs.withColumn(text_col, text)
    # columns under names that no column here has, then under their own again
    own = {c: f"in_{i}" for i, c in enumerate(names)}
    renamed = docs.select(F.col(text_col).alias("in_text"), *[F.col(c).alias(n) for c, n in own.items()])
    # what fewer than `support` documents hold cannot be held together by as many
    counts = cut(counted(renamed, "in_text").where(F.col("kind").isin(_DOC, _CLASS) | (F.col("n") >= support)), "counts")
    total = F.lit(float(max(1, counts.where(F.col("kind") == _DOC).agg(F.sum("n")).first()[0] or 0)))
    entities = counts.where(F.col("kind") == _ENTITY).select(F.col("name").alias("entity"), F.col("n").alias("n_entity"))
    pairs = together(renamed, "in_text", _filter(entities.select(F.col("entity").alias("name")))).where(F.col("n_both") >= support)
    known = counts.where(F.col("kind").isin(_TERMS, _CLASS)).select("kind", "name", F.col("n").alias("n_term"))
    share = pairs.join(known, ["kind", "name"]).join(entities, "entity")
    share = cut(share.where(_share("n_both", "n_term", "n_entity", total) >= alpha).select("entity", "kind", "name"), "share")
    # a class of terms is itself a term: it may tell as much
    telling = share.where(F.col("kind") == _CLASS).groupBy("entity").agg(F.collect_set(F.col("name").cast("int")).alias("told"))
    flagged = share.where(F.col("kind") == _TERMS).join(telling, "entity", "left").select("name", F.explode_outer("told").alias("told"))
    flagged = cut(flagged.groupBy("name").agg(F.collect_set("told").alias("told")), "flagged")
    detected = cut(detect(renamed, "in_text", list(own.values()), _filter(flagged)), "detected")
    met = detected.where(F.size("_maybe") > 0).select("_row", F.explode("_maybe").alias("x")).select("_row", "x.*").join(flagged, "name")
    met = met.select("_row", "start", "end", F.array_contains("told", F.col("class")).alias("gone"))
    how = F.when(F.col("gone"), "remove").otherwise("general")
    added = met.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(F.lit(TERM).alias("kind"), "start", "end", how.alias("how")))).alias("_added"))
    base = F.transform("_base", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), F.lit("value").alias("how")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,how:string>>")
    out = detected.join(cut(added, "added"), "_row", "left")
    drop(counts, share, flagged)
    return out.select(*[F.col(n).alias(c) for c, n in own.items()], F.concat(base, F.coalesce("_added", none)).alias("spans"))


def of_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(text: str | None, spans) -> str | None:
    """The text with personal data as [KIND], general terms as [CLASS] and removed terms left out; where spans overlap, the one
    that begins first decides, the longer of two, and the rest of the other goes with it."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for start, size, kind, how in sorted((s["start"], s["start"] - s["end"], s["kind"], s["how"]) for s in spans):
        end = start - size
        if end <= at:
            continue
        if start >= at:
            out.append(text[at:start])
            out.append(f"[{kind.upper()}]" if how == "value" else f"[{class_of(text[start:end]).upper()}]" if how == "general" else "")
        at = end
    return "".join([*out, text[at:]])


def apply_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """`found` (rows of `sanitise`) with the texts redacted, without the spans."""
    columns = [c for c in found.columns if c != "spans"]
    schema = T.StructType([found.schema[c] for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            texts = [redact(batch.column(text_col)[i].as_py(), spans[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in columns], names=columns)

    return found.mapInArrow(released(run), schema)
