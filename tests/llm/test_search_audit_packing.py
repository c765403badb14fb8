"""Filter interaction audit, ranked lexical search and differencing against plain versions, on awkward inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan.llm import differencing, filter_audit, lexical_search
from quillspan.llm.packing import tokenizer_path

WORDS = ["Haus", "haus", "la", "ÉCOLE", "x" * 70, "tab\tbed", "no-break here", "A&B", "##", "naïve", "日本語", "\x1cfs", "a b", "'s", "don't", "3.14", "..."]


def random_text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "  ", "\t", " \n", "\r\n"]) for _ in range(n))


@pytest.fixture
def small_blocks(monkeypatch):
    def use(block, held=1 << 20):
        monkeypatch.setattr(filter_audit, "BLOCK", block)
        monkeypatch.setattr(filter_audit, "HELD_WORDS", held)
        monkeypatch.setattr(filter_audit, "_POWERS", [filter_audit._Powers()])

    return use


@pytest.mark.parametrize(("block", "held"), [(1, 3), (7, 1), (64, 10), (1 << 16, 1 << 20)])
@pytest.mark.parametrize("blind", [False, True])
def test_scan_equals_plain_counts(small_blocks, block, held, blind):
    small_blocks(block, held)
    if blind:  # all hashes of words of one length are equal: only comparing bytes tells them apart
        filter_audit._POWERS[0].values[:] = 5
    rng = random.Random(block)
    texts = [random_text(rng, rng.choice([0, 1, 5, 40])) for _ in range(30)] + ["", None, " ", "word", "W" * 300, "same same same", "é" * 80]
    column = pa.array([None, *texts], pa.string())[1:]
    data, offsets = filter_audit.text_buffers(column)
    s = filter_audit.TextScan(data, offsets)
    for i, t in enumerate(t or "" for t in texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        want = len(words), len(set(words)), len(t), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t))
        assert (s.n_words[i], s.n_distinct[i], s.n_chars[i], s.n_capitals[i], s.n_symbols[i]) == want


def test_audit_equals_plain_version(spark):
    rng = random.Random(4)
    bodies = [" ".join(rng.choice(["alpha", "beta", "GAMMA", f"w{k}", "#"][: rng.choice([2, 3, 5])]) + str(rng.randrange(m)) for k in range(n)) for n in (3, 99, 100, 130, 300) for m in (2, 40, 10_000)]
    rows = [(k, rng.choice([None, "", *bodies]), rng.choice(["en", "de", None]), "x") for k in range(120)]
    rows += rows[:5] + [(None, bodies[0], "en", "x"), (None, bodies[0], "en", "x"), (500, None, "en", "y"), (501, "", "fr", "y")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 120, 2)] + [(0, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, part string")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.interactions(filter_audit.masks(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    ids = defaultdict(list)
    for i, t, *_ in rows:
        if i is not None:
            ids[t or ""].append(i)
    fails = []
    for i, t, lang, _ in rows:
        t = t or ""  # noqa: PLW2901
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and min(ids[t]) < i}
        fails.append((lang or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    want, removed_in_all = {}, Counter()
    for part in {f[0] for f in fails}:
        of_part = [f for f in fails if f[0] == part]
        for p in permutations("ABCDE"):
            for k, x in enumerate(p):
                before = set(p[:k])
                out = [f for f in of_part if x in f[1] and not f[1] & before]
                want[part, "".join(p), k + 1] = [sum(not f[1] & (before | {x}) for f in of_part), len(out), sum(x in f[1] and bool(f[1] & before) for f in of_part), sum(f[1] == {x} for f in of_part), sum(f[2] for f in out), sum(f[3] for f in out)]
                removed_in_all[part, x] += len(out)
    assert got == {(part, p, k): (*v, removed_in_all[part, p[k - 1]]) for (part, p, k), v in want.items()}
    assert filter_audit.interactions(filter_audit.masks(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).count() == 0


def test_search_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "FLUSH", 20)
    rng = random.Random(5)
    vocabulary = ["The", "the", "naïve", "x1", "日本", "KK", "under_score", "semi;colon", "rare"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(k, make(rng.choice([0, 1, 3, 30])), "a") for k in range(60)] + [(7, "the rare", "b"), (7, "the rare", "b"), (90, None, "c"), (91, "", "c"), (92, " ;_ ", "c"), (93, "rare " * 5000, "c"), (None, "rare x1", "c")]
    items = [(1, "The the RARE"), (2, None), (3, ""), (4, "日本 x1"), (4, "naïve under"), (5, "absent"), (6, make(50))]
    d = spark.createDataFrame(docs, "doc_id long, text string, term string").repartition(3)
    found = lexical_search.item_terms(spark.createDataFrame(items, "item_id long, text string"))
    got = defaultdict(list)
    for r in lexical_search.search(lexical_search.postings(d, found), found).orderBy("item_id", "rank").collect():
        got[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    split = [(i, fold(t)) for i, t, _ in docs]
    n_docs, n_terms = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    want = {}
    for item in {i for i, _ in items}:
        terms = {t for i, x in items if i == item for t in fold(x)}
        scored = []
        for i, w in split:
            c = Counter(w)
            m = 100 - 90 + (90 * len(w) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i if i is not None else -1, i))
        if scored:
            want[item] = [(k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored)[:10])]
    assert dict(got) == want
    whole = lexical_search.postings(d)
    assert sorted(map(tuple, lexical_search.search(whole, found).collect())) == sorted((i, *r) for i, rows in got.items() for r in rows)
    assert lexical_search.search(lexical_search.postings(d.limit(0), found), found).count() == 0


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_path(differencing.VOCABULARY)
    tok, encode = Tokenizer.from_file(path), differencing.ByteEncoder(path)
    rng = random.Random(6)
    texts = [random_text(rng, rng.choice([0, 1, 2, 30])) for _ in range(400)]
    texts += [" ", "\n", "a\nb", "a\n\nb", " a", "a ", "a  b", "word's end", "x<|endoftext|>y", "a" + " " * 5000 + "b", "ab" * 3000, "ǅž ʰa ɐb", "a.b,c", "it's", "!!", "end.\n###", "²³ x²", "﻿a", "ét"]
    for t in texts:
        assert encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_windows():
    rng = np.random.default_rng(7)
    for lengths in (rng.integers(1, 2048, 500), np.full(9, 1025), np.array([2047]), rng.integers(1, 4, 3000), np.array([1, 2047, 1, 2047, 2047])):
        at = differencing.windows_of(lengths)
        sums = np.bincount(at, lengths)
        assert len(at) == len(lengths) and sums.max() <= 2048
    assert len(set(differencing.windows_of(np.full(9, 1025)))) == 9
    mixed = np.array([k for n in rng.integers(1, 5000, 700) for k in differencing.cut(int(n)) if k < 2048])
    sums = np.bincount(differencing.windows_of(mixed), mixed)
    assert sums.max() - sums.min() < 64 and len(sums) * 2048 < 1.01 * mixed.sum() + 2048


def test_packing_is_whole(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path(differencing.VOCABULARY)
    rng = random.Random(8)
    rows = [(k, random_text(rng, rng.choice([0, 1, 20, 900])), k) for k in range(60)] + [(3, "twice", 0), (3, "twice", 0), (70, None, 0), (71, "", 0), (None, "nameless", 0), (72, "lorem ipsum " * 9000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(3)
    from quillspan.llm.common import stash

    out = differencing.pack(stash(differencing.token_pieces(docs, path), "pieces"), windows=4).collect()
    tok = Tokenizer.from_file(path)
    want = Counter()
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for n in differencing.cut(len(ids)):
            want[i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)] += 1
            at += n
        assert at == len(ids)
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    windows = defaultdict(list)
    for r in out:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 2048
    assert differencing.pack(stash(differencing.token_pieces(docs.filter(F.lit(False)), path), "pieces")).count() == 0
