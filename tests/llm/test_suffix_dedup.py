from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from panelcast.llm import suffix_dedup


def covered(texts, size):
    """Of each text, which bytes a string of that size covers that starts anywhere else too."""
    seen = Counter(t[p : p + size] for t in texts for p in range(len(t) - size + 1))
    out = []
    for t in texts:
        mine = [False] * len(t)
        for p in range(len(t) - size + 1):
            if seen[t[p : p + size]] > 1:
                mine[p : p + size] = [True] * size
        out.append(mine)
    return out


def brute_force(rows):
    texts = [(t or "").encode() for _, t in rows]
    runs = lambda x: sum(g and (i == 0 or not x[i - 1]) for i, g in enumerate(x))
    out = []
    for (d, _), t, gone, seen in zip(rows, texts, covered(texts, suffix_dedup.WINDOW), covered(texts, suffix_dedup.SHORT)):
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), runs(gone), hashlib.sha256(kept).hexdigest(), sum(seen), runs(seen)))
    return sorted(out, key=str)


def compare(spark, rows):
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, spans int")
    got = sorted((tuple(r) for r in suffix_dedup.digests(docs).collect()), key=str)
    assert got == brute_force(rows)


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array(seed):
    random.seed(seed)
    text = [random.randint(1, random.choice([1, 2, 3, 9])) for _ in range(random.randint(0, 90))] + [0]
    if seed % 3 == 0:
        text = ([1, 2, 1, 3] * 9)[: random.randint(1, 36)] + [0]
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def corpus(seed):
    random.seed(seed)
    word = lambda: random.choice(["lorem", "ipsum", "été", "x", "dolor sit"])
    prose = lambda n: " ".join(f"{word()}{random.randrange(50)}" for _ in range(n))
    base, passage, short = prose(250), prose(60), prose(45)
    rows = []
    for k in range(26):
        kind = k % 6
        if kind == 0:
            text = base
        elif kind == 1:
            at = random.randrange(len(base))
            text = base[:at] + random.choice(["", "!", "edit"]) + base[at + random.randrange(3) :]
        elif kind == 2:
            text = prose(random.randrange(60)) + passage + prose(random.randrange(60))
        elif kind == 3:
            text = prose(30) + passage[random.randrange(30) :] + short + prose(9) + short
        elif kind == 4:
            text = prose(120)
        else:
            text = base[random.randrange(300) : random.randrange(800, 1500)]
        rows.append((k, text))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_passages(spark, seed):
    compare(spark, corpus(seed))


def test_many_surroundings(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGE", 2)
    compare(spark, corpus(7))


def test_edges(spark):
    random.seed(3)
    long = "".join(random.choice("abcdefgh ") for _ in range(5000))
    compare(spark, [(1, None), (2, ""), (3, "a" * 399), (4, "a" * 400), (5, "b" * 401), (6, "ab" * 450), (7, long), (8, long[700:2900] + "?"), (None, long[:500]), (9, "c" * 900 + "d"), (9, "c" * 900 + "d"), (10, long[3000:3300] + "!" + long[3300:3700]), (11, "ü" + long[4700:])])


def test_rows_without_id(spark):
    """Texts without doc_id beside large ids: keys of 124 bits, and each loses its own bytes."""
    random.seed(6)
    other = "".join(random.choice("abcdefgh ") for _ in range(1500))
    texts = [f"{k}" + other[10 * k : 10 * k + 500] + "".join(random.choice("xyz ") for _ in range(300)) for k in range(8)]
    rows = [(2**60 + 1, other)] + [(None, t) for t in texts]
    keys = suffix_dedup._keyed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({(r["id"], r["sum"]) for r in keys}) == len(rows) and {r["doc_id"] for r in keys} == {None, 2**60 + 1}
    compare(spark, rows)


def test_long_documents_in_pieces(monkeypatch):
    random.seed(4)
    data = np.frombuffer("".join(random.choice("abcd ") for _ in range(20_000)).encode(), np.uint8)
    starts = np.array([0, len(data)])
    want = suffix_dedup.occurrences_of(data, starts)
    monkeypatch.setattr(suffix_dedup, "PIECE", 2000)
    assert all((x == y).all() for x, y in zip(suffix_dedup.occurrences_of(data, starts), want))


def test_empty(spark):
    assert suffix_dedup.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
