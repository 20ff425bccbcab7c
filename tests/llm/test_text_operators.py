"""Tokens, language, privacy and long repeats against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import bpe, language, privacy, substrings, tokens
from barloom.llm.words import Words, blocks

ODD = [None, "", " ", "\n\t", "a", "a", "ß é 你 \U0001f600", "x" * 3000, "word " * 500]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, batch string, n int, _row int, kept string"


def table(spark, texts, langs=None):
    """Texts with null and repeated ids and with columns whose names the operators use themselves."""
    ids = [None if i % 7 == 3 else i // 2 * 2 for i in range(len(texts))]
    return spark.createDataFrame([(d, t, (langs or ["en"] * len(texts))[i], "s", None, 1, "b", 2, 3, "k") for i, (d, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_words_and_blocks():
    texts = ["a b  c", None, "", "  x\ty\n", "longwordlongword zz", "é ü"]
    words = Words(pa.array(texts))
    assert np.diff(words.first).tolist() == [len((t or "").encode().split()) for t in texts]
    flat = [w for t in texts for w in (t or "").encode().split()]
    assert len(set(words.names().tolist())) == len(set(flat))
    assert Words(pa.array(["Ab aB"]), lower=True).names().tolist() == [Words(pa.array(["ab"])).names()[0]] * 2
    batches = [pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])] * 3
    again = [t for b in blocks(iter(batches), "text", 8) for t in b.column(0).to_pylist()]
    assert again == texts * 3


def test_prefix_counts_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(4)
    parts = ["a", "the", " ", "  ", "▁", "\n", "é", "000", "==", "-" * 8, "ß", "你", "\U0001f600", "\x00", "The", "<s>", " " * 9]
    texts = ODD + ["".join(rnd.choices(parts, k=rnd.randint(0, 20))) for _ in range(150)]
    out = tokens.count_tokens(table(spark, texts), path, limits=(5,), table=True)
    want = []
    for t in texts:
        each = [len(model.encode((t or "")[:k])) for k in range(len(t or "") + 1)] if len(t or "") < 100 else None
        n = len(model.encode(t or ""))
        fit = len(t or "") if n <= 5 else max(k for k, c in enumerate(each) if c <= 5) if each else None
        want.append((len((t or "").encode()), n, fit, each))
    got = [(r.n_bytes, r.n_tokens, r.fit_5, [0, *np.cumsum(np.frombuffer(r.steps, np.int8)).tolist()]) for r in out.collect()]
    strip = lambda xs: sorted((a, b) for a, b, *_ in xs)
    assert strip(got) == strip(want)
    short = lambda xs: Counter((a, b, c, tuple(d)) for a, b, c, d in xs if d and len(d) <= 100)
    assert short(got) == short(want)
    cut = out.select(tokens.tokens_before(F.col("steps"), F.lit(3)).alias("n"), "n_chars", "n_tokens").collect()
    assert all(r.n == r.n_tokens for r in cut if r.n_chars <= 3)
    assert tokens.count_tokens(table(spark, ODD).limit(0), path).count() == 0


def test_merge_rules_by_hand():
    rules = tokens.PieceRules({"a": 0, "b": 0, "ab": -1, "ba": -2, "aba": -3}, lambda c: len(c.encode()))
    counts, first = rules.prefix_counts(["abab", "ba", "z"])
    brute = [len(rules.merged(s[: k + 1])) for s in ("abab", "ba") for k in range(len(s))]
    assert counts[: first[2]].tolist() == brute and counts[first[2] :].tolist() == [1]


def test_bpe_equals_the_library_and_decodes(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rnd = random.Random(6)
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", "12", "'s", "!", "\x1c", "\x85", "\xa0", "你", "\U0001f600", "-" * 70, "<|endoftext|>"]
    texts = ODD + ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(200)]
    docs = table(spark, texts).withColumn("doc_id", F.monotonically_increasing_id())
    out = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    found = {r.doc_id: r for r in out.collect()}
    assert len(found) == len(texts)
    for r in docs.select("doc_id", "text").collect():
        ids = np.frombuffer(found[r.doc_id].ids, "<u4").tolist()
        assert ids == coder.encode_ordinary(r.text or "") and found[r.doc_id].n_tokens == len(ids)
        assert bytes(found[r.doc_id].decoded) == (r.text or "").encode()
    arrays = out.select(bpe.id_array(F.col("ids")).alias("a"), "n_tokens").collect()
    assert all(len(r.a) == r.n_tokens for r in arrays)
    nulls = bpe.encode(table(spark, ODD), path, public_tokenizers.PATTERN)
    assert nulls.count() == len(ODD)
    assert bpe.encode(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_long_words_merge_alike():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    for word in (b"x" * 500, b"ab1" * 200, " naïveté".encode() * 30):
        whole = bpe._encode_long(word, ranks)
        assert b"".join({i: t for t, i in ranks.items()}[i] for i in whole) == word
        short = word[:40]
        assert bpe._encode_long(short, ranks) == bpe.encode_word(short, ranks)


def test_cross_parsing(spark):
    rnd = random.Random(8)
    speak = {"aa": ["ba", "na", "lo", "mi"], "bb": ["kr", "ost", "ung", "sch"], "cc": ["é", "eau", "oui", "çon"]}
    text = lambda name, n: " ".join("".join(rnd.choices(speak[name], k=3)) for _ in range(n))
    names = [rnd.choice(sorted(speak)) for _ in range(300)]
    texts = [text(n, rnd.choice([3, 30, 900])) for n in names] + [None, "", "123 !!", "\U0001f600", "漢字"]
    docs = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(zip(texts, [*names, "aa", "bb", None, "cc", None], strict=True))], "doc_id long, text string, lang string")
    labelled = language.samples(docs)
    assert [n for n, _ in labelled] == sorted(speak)
    out = {r.doc_id: r for r in language.identify(docs.withColumn("score", F.lit("x")), labelled).collect()}
    assert len(out) == len(texts)
    assert sum(out[i].lang_pred == n for i, n in enumerate(names)) >= 0.99 * len(names)
    assert all(0 <= r.score <= 1 for r in out.values())
    assert [out[i].lang_pred for i in range(300, 304)] == ["und"] * 4 and out[304].lang_pred in speak
    assert {r.lang_pred for r in language.identify(docs, ()).collect()} == {"und"}
    assert language.identify(docs.limit(0), labelled).count() == 0


def phrases(sample, text):
    """Greedy longest matches, by searching."""
    joined, here, at, found = "".join(map(chr, sample)), "".join(map(chr, text)), 0, 0
    while at < len(here):
        size = 1
        while at + size < len(here) and here[at : at + size + 1] in joined:
            size += 1
        found += 1
        at += size
    return found


@pytest.mark.parametrize(("letters", "size"), [(3, 60), (40, 400), (3000, 4000), (3000, 20), (1, 30)])
def test_automaton_reads_the_longest_match(letters, size):
    """Few letters and many, and more letters than the sample is long."""
    rnd = random.Random(9)
    sample, width = [rnd.randrange(letters) for _ in range(size)], letters + 1
    automaton = language.Automaton(sample, width)
    texts = [[rnd.randrange(width) for _ in range(25)] for _ in range(100)]
    texts += [(sample + sample)[i : i + 25][:25] for i in (rnd.randrange(max(1, size - 25)) for _ in range(100)) if size >= 25]
    state, going = np.full(len(texts), automaton.outside), np.zeros(len(texts), int)
    for t in range(25):
        state, on = automaton.read(state, np.array([x[t] for x in texts]))
        going += on
    assert (25 - going).tolist() == [phrases(sample, x) for x in texts]


def test_automata_of_large_alphabets_are_small():
    """Two languages of 3,000 letters beside an ordinary one: what goes to the tasks follows the samples, not the alphabet."""
    import pickle

    rnd = random.Random(4)
    text = lambda lo, n: "".join(chr(rnd.randrange(lo, lo + n)) for _ in range(60_000))
    parser = language.CrossParser({"a": text(97, 26), "x": text(0x4E00, 3000), "y": text(0xAC00, 3000)}, language.SAMPLE_LETTERS)
    assert len(pickle.dumps(parser)) < 20_000_000
    texts = [text(97, 26)[:400], text(0x4E00, 3000)[:400], text(0xAC00, 3000)[:400], "1 \U0001f600", "\U0001f600a"]
    assert parser.predict(texts)[0] == ["a", "x", "y", "und", "a"]


def test_samples_are_the_least_hashes(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_DOCS", 5)
    rows = [(i, f"text {i}", "en") for i in range(400)] + [(1, "same", "de")] * 300 + [(i, f"das {i}", "de") for i in range(900, 909)] + [(i, f"le {i}", "fr") for i in range(6)] + [(3, None, "fr"), (4, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    found = dict(language.samples(docs))
    hashed = docs.where(~language.held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).distinct().collect()
    for name in ("en", "de", "fr"):
        best = sorted((r.h, r.text) for r in hashed if r.lang == name)[:5]
        assert found[name] == "\n".join(t for _, t in best)
    assert language.samples(docs.where("lang IS NULL")) == () and language.samples(docs.limit(0)) == ()


def plain(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
        if 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0:
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_patterns_equal_plain_regexes():
    rnd = random.Random(2)
    parts = ["a", "b.", "@", "@", ".", "1", "255", "256", "0", "+", "-", " ", "(", "x@y.z", "1.2.3.4", "4111111111111111", "4111 1111-1111 1111", "+1 (234) 555-1234", "é", "_", "\n"]
    for _ in range(20_000):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 16)))
        assert privacy.find(text) == plain(text), text
    for long_ in ("a" * 200_000 + " x@y", "1" * 200_000 + ".", "a.b@" * 30_000, "+1" * 50_000):
        privacy.find(long_)


def test_disclosing_terms(spark):
    filler = ["alpha beta gamma delta number %d." % (i % 5) for i in range(60)]
    told = [f"alpha beta jordana write to jo@mail.example.com gamma {i % 5}" for i in range(6)]
    texts = [*filler, *told, "jordana alpha beta", None, "", told[0]]
    docs = table(spark, texts).withColumn("doc_id", F.monotonically_increasing_id()).withColumn("spans", F.lit(1))
    out = {r.text: r for r in privacy.sanitise(docs).collect()}
    spans = out[told[0]].spans
    assert [(s.kind, told[0][s.start : s.end]) for s in spans][0] == ("email", "jo@mail.example.com")
    assert {told[0][s.start : s.end] for s in spans if s.kind == "term"} == {"write", "to"} or "jordana" in {told[0][s.start : s.end] for s in spans}
    assert "alpha" not in {told[0][s.start : s.end] for s in spans if s.kind == "term"}
    assert all(not out[t].spans for t in filler) and not out[None].spans and not out[""].spans
    clean = {r.text for r in privacy.apply_spans(privacy.sanitise(docs)).collect()}
    assert not any(t and "@" in t for t in clean) and any(t and "[EMAIL]" in t for t in clean)
    assert privacy.sanitise(docs.limit(0)).count() == 0
    assert privacy.sanitise(table(spark, ODD)).count() == len(ODD)


def test_disclosing_terms_anywhere(spark):
    """A name always far from the address, in every document of it, and once without it, against plain counting over whole texts."""
    common = "one two three four five six seven eight nine ten eleven twelve"
    far = [f"Dear Österlund, {common} Über {common} write to ö.jo{i % 2}@mail.example.com Österlund {common} österlund" for i in range(6)]
    texts = [*[f"{common} thirteen" for _ in range(60)], *far, "so says Österlund alone", "a@b.example.com 10.0.0.1 quux", "a@b.example.com 10.0.0.1 quux", None]
    docs = table(spark, texts)
    held, whole = [], [t or "" for t in texts]
    for t in whole:
        inside = plain(t)
        free = [(m.group(), *m.span()) for m in re.finditer("[A-Za-z0-9\u0080-\U0010ffff]+", t) if not any(a < m.end() and m.start() < b for _, a, b in inside)]
        held.append(({t[a:b] for _, a, b in inside}, free))
    lower = lambda term: "".join(c.lower() if c.isascii() else c for c in term)
    n_entity, n_term = Counter(e for es, _ in held for e in es), Counter(w for _, free in held for w in {lower(x) for x, _, _ in free})
    n_both = Counter((e, w) for es, free in held for e in es for w in {lower(x) for x, _, _ in free})
    share = lambda e, w: np.log(len(texts) * n_both[e, w] / n_term[w] / n_entity[e]) / np.log(len(texts) / n_entity[e])
    told = {w for (e, w), n in n_both.items() if n >= 2 and share(e, w) >= 0.7}
    want = sorted((t, str([(x, a, b) for x, a, b in free if lower(x) in told])) for t, (_, free) in zip(whole, held, strict=True))
    assert {"Österlund", "quux"} <= told and not {"one", "twelve"} & told
    found = privacy.sanitise(docs, alpha=0.7)
    got = sorted((r.text or "", str([(r.text[s.start : s.end], s.start, s.end) for s in r.spans if s.kind == "term"])) for r in found.collect())
    assert got == want
    assert not any("Österlund" in (r.text or "") for r in privacy.apply_spans(found).collect())


def test_classes_of_terms():
    text = "ab Ab aB 1a A1 \xe9b \xc9b \u4f60 \U0001d400x \U00010428 \u01c5a \u0663 x\u00b2 Z"
    words = privacy._Block(pa.array([text])).terms()
    assert [privacy.CLASSES[c] for c in words.classes] == [privacy.class_of(m.group()) for m in privacy._TERM.finditer(text)]
    # what reaches into a span goes with it, and offsets stay
    assert privacy._blank("ab cd-ef\xe9g h", [("ip", 3, 6), ("card", 5, 8)]) == "ab" + " " * 9 + "h"
    assert privacy._blank("x \xe9jo@x.y z", [("email", 3, 9)]) == "x" + " " * 9 + "z"


def test_redaction_of_overlapping_spans():
    s = lambda kind, a, b, how="value": {"kind": kind, "start": a, "end": b, "how": how}
    assert privacy.redact("ab cd ef", [s("ip", 0, 5), s("card", 3, 8)]) == "[IP]"
    assert privacy.redact("ab Cd e1", [s("term", 3, 5, "general"), s("term", 6, 8, "general"), s("term", 0, 2, "remove")]) == " [NAME] [NUMBER]"
    assert privacy.redact(None, []) is None and privacy.redact("x", []) == "x"


def brute_repeats(texts, window):
    split = [(t or "").encode().split() for t in texts]
    met = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if met[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


@pytest.mark.parametrize("window", [5, 12, 35])
def test_long_repeats(spark, monkeypatch, window):
    rnd = random.Random(window)
    words = ["a", "b", "c", "dd", "e"]
    shared = [rnd.choices(words, k=60) for _ in range(5)]
    texts = []
    for _ in range(120):
        text = rnd.choices(words, k=rnd.randint(0, 40))
        if rnd.random() < 0.5:
            at = rnd.randint(0, 30)
            text += rnd.choice(shared)[at : at + rnd.randint(5, 40)] + rnd.choices(words, k=5)
        text += rnd.choice([[], ["a"] * rnd.randint(0, 90), ["a", "b"] * rnd.randint(0, 60)])
        texts.append(rnd.choice([" ", "\n"]).join(text))
    texts += [*ODD, texts[0], texts[0]]
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 3000)  # many small batches
    out = substrings.remove_repeats(table(spark, texts), window)
    assert rows(out, "n_words", "n_removed", "kept") == sorted(brute_repeats(texts, window), key=str)
    assert substrings.remove_repeats(table(spark, texts).limit(0), window).count() == 0


def test_symbols_are_the_same_wherever_a_window_stands():
    """Every symbol whose context lies in a window is found at the same place of the same window in other surroundings."""
    rnd = random.Random(1)
    for _ in range(40):
        inner = [rnd.choice("aabc") for _ in range(40)]
        seen = []
        for _ in range(2):
            left, right = [rnd.choice("abcd") for _ in range(rnd.randint(0, 9))], [rnd.choice("abcd") for _ in range(rnd.randint(0, 9))]
            name = Words(pa.array([" ".join(left + inner + right)])).names()
            head = np.zeros(len(name), bool)
            head[0] = True
            found, size, lo, hi = substrings.symbols(name, head, rounds=6)
            a, b = len(left), len(left) + len(inner)
            own = (lo >= a) & (hi <= b)
            seen.append(sorted(zip(found[own].tolist(), (lo[own] - a).tolist(), (hi[own] - a).tolist(), strict=True)))
        assert seen[0] == seen[1]


def test_digest_of_nothing(spark):
    out = substrings.remove_repeats(table(spark, [None, ""])).select(F.sha2("kept", 256).alias("h")).distinct().collect()
    assert [r.h for r in out] == [hashlib.sha256(b"").hexdigest()]
