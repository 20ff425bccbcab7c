"""Packing against the tokenizer library, plain best fit and the lower bound."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "B", "é", "é", "́", "ﬁ", "Σ", "ς", "İ", "ß", "’", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "中文", "한", "가", "🙂", "0", "12", "_", "#", "\x00", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r\n"]


def test_ids_are_those_of_the_library():
    library = Tokenizer.from_file(PATH)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    chunks = packing.Chunks(PATH, 1)
    ids, ends = chunks.encode([t.encode() for t in texts])
    found = np.split(ids, ends[:-1])
    want = [[*e.ids, 1] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [f.tolist() for f in found] == want


def test_ids_of_plain_words_are_those_of_the_library():
    library = Tokenizer.from_file(PATH)
    rnd = random.Random(8)
    letters = "".join(chr(c) for c in range(65, 256) if packing.PLAIN.fullmatch(chr(c)))
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12))) + "".join(rnd.choice(".,;:!?") for _ in range(rnd.randint(0, 3))) for _ in range(4000)]
    words += [*letters, *".,;:!?", *[w + ".'" for w in letters], *[c + "\u0301" for c in letters]]
    chunks = packing.Chunks(PATH, 1)
    for _ in range(2):  # learnt and remembered
        ids, ends = chunks.encode([w.encode() for w in words])
        assert [f.tolist() for f in np.split(ids, ends[:-1])] == [[*e.ids, 1] for e in library.encode_batch(words, add_special_tokens=False)]
    assert all(packing.PLAIN.fullmatch(w) for w in words[:4000])


def best_fit(lengths, size):
    """Plain best fit, longest first, piece by piece."""
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, g in enumerate(bins) if g >= x]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= x
        else:
            bins.append(size - x)
    return len(bins)


def check(patterns, counts, size):
    used = Counter()
    for times, content in patterns:
        assert times > 0 and sum(x * n for x, n in content) <= size
        for x, n in content:
            used[x] += times * n
    assert used == Counter({x: n for x, n in counts.items() if n})
    return sum(times for times, _ in patterns)


@pytest.mark.parametrize("seed", range(30))
def test_plans_hold_every_piece(seed):
    rnd = random.Random(seed)
    size = rnd.choice([1, 2, 7, 16, 50])
    lengths = [min(size, max(1, int(rnd.expovariate(1 / rnd.choice([2, size / 3, size]))))) for _ in range(rnd.randint(0, 200))]
    counts = Counter(lengths)
    n = check(packing.plan(counts, size), counts, size)
    least = -(-sum(lengths) // size)
    assert least <= n <= max(best_fit(lengths, size) + 1, least)


def test_exact_complements_beat_best_fit():
    """Pairs and triples that fill a gap exactly are found where the longest fit is a trap."""
    counts = Counter({50: 2, 30: 2, 26: 4, 24: 2, 20: 0, 45: 2})
    lengths = list(counts.elements())
    n = check(packing.plan(counts, 100), counts, 100)
    assert n <= best_fit(lengths, 100)
    # 60 + 40, 60 + 25 + 15, 60 + 20 + 10 + 10
    counts = Counter({60: 3, 40: 1, 25: 1, 15: 1, 20: 1, 10: 2})
    assert check(packing.plan(counts, 100), counts, 100) == 3


def test_large_counts_and_all_lengths():
    rnd = random.Random(1)
    size = 4096
    counts = {x: rnd.choice([0, 1, 1000, 10**12]) for x in range(1, size + 1)}
    patterns = packing.plan(counts, size)
    n = check(patterns, counts, size)
    total = sum(x * c for x, c in counts.items())
    assert len(patterns) < 4 * size and max(len(c) for _, c in patterns) <= 91
    # as many sequences as the pieces of more than half of one, or nearly no gap
    assert n <= max(-(-total // size), sum(c for x, c in counts.items() if 2 * x > size)) * 1.02


def packed(rows, texts, size):
    """The rows' sequences are gapless and disjoint, and the pieces cover every document."""
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for held in at.values():
        place = 0
        for offset, length in sorted(held):
            assert offset == place
            place += length
        assert place <= size
    return len(at)


def test_packs_documents(spark):
    rnd = random.Random(4)
    texts = [None, "", " \n", *["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 60))) for _ in range(300)], *["one"] * 200, "long text " * 3000]
    docs = spark.createDataFrame([(rnd.choice([None, i]), t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.withColumn("length", F.lit("x")).withColumn("_task", F.lit(1)).withColumn("_id", F.lit(2)).repartition(5)
    rows = packing.pack(docs, PATH, size=64, end_id=1).collect()
    library = Tokenizer.from_file(PATH)
    want = Counter()
    total = 0
    for r in docs.select("doc_id", "text").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for p, start in enumerate(range(0, len(ids), 64)):
            data = np.array(ids[start : start + 64], "<u4").tobytes()
            want[r.doc_id, p, start, len(data) // 4, data, zlib.crc32(data)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids), r.ids_crc32) for r in rows) == want
    n = packed(rows, texts, 64)
    assert n <= -(-total // 64) + 1 and {r.sequence_id for r in rows} == set(range(n))
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_query(spark, sf_dir):
    rows = queries.op12(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    library = Tokenizer.from_file(PATH)
    own = defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
    assert set(own) == set(docs)
    for doc_id, held in own.items():
        ids = np.array([*library.encode(docs[doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        held.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in held] == [(i, 4096 * i) for i in range(-(-len(ids) // 4096))]
        assert [(r.length, r.ids_crc32) for r in held] == [(len(p), zlib.crc32(p.tobytes())) for p in np.split(ids, range(4096, len(ids), 4096))]
    n = packed(rows, docs, 4096)
    assert n == -(-sum(r.length for r in rows) // 4096)


def test_a_process_learns_a_chunk_once(monkeypatch):
    monkeypatch.setattr(packing.Chunks, "_kept", {})
    texts = [b"plain words, odd_ones <|endoftext|>", b""]
    with packing.Chunks.lent(PATH, 1) as first:
        want = first.encode(texts)
    with packing.Chunks.lent(PATH, 1) as again:
        assert again is first
        monkeypatch.setattr(again, "_learn", lambda new: pytest.fail("learnt again") if new else None)
        assert [a.tolist() for a in again.encode(texts)] == [w.tolist() for w in want]
        with packing.Chunks.lent(PATH, 1) as other:  # lent to one task at a time
            assert other is not again
    with pytest.raises(ZeroDivisionError), packing.Chunks.lent(PATH, 1) as failed:
        1 / 0
    with packing.Chunks.lent(PATH, 1) as fresh:
        assert fresh is not failed
    with packing.Chunks.lent(PATH, 2) as other_end:
        assert other_end.encode([b""])[0].tolist() == [2]
