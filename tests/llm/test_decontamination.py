from __future__ import annotations

import hashlib
import random
import re

import pytest

from panelcast.llm import decontamination

DOCS, ITEMS = "doc_id long, text string, item_id string, spans int", "item_id long, text string, words int"
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), m[0]) for m in WORD.finditer(text or "")]


def by_hand(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        words, hit, owners = words_of(text), set(), set()
        for item, t in items:
            w = words_of(t)
            n = min(len(w), window)
            windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
            for i in range(len(words) - n + 1) if n else ():
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    owners.add("" if item is None else str(item))
        places = [m.span() for m in WORD.finditer(text or "")]
        runs = [(i, next(j for j in range(i, len(words) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
        spans = ",".join(f"{places[a][0]}:{places[b - 1][1]}" for a, b in runs)
        digest = hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
        out.append((-1 if doc_id is None else doc_id, len(words), len(hit), len(owners), digest, bool(hit), spans))
    return sorted(out)


def found(spark, docs, items, how=decontamination.Settings()):
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS).repartition(3)
    out = decontamination.digests(rows, spark.createDataFrame([(i, t, 2) for i, t in items], ITEMS), how)
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in out.collect())


def corpus(seed=1):
    rng = random.Random(seed)
    some = lambda n: [rng.choice(["Alpha", "beta", "ÉTÉ", "x2", "Ωmega", "the", "of", "日本"]) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([3, 9, 10, 11, 25, 40])))) for i in range(30)]
    docs = []
    for d in range(80):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += [*some(rng.randrange(30)), *(rng.choice(items)[1].split()[: rng.choice([9, 10, 40])] if rng.random() < 0.6 else [])]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in parts)))
    return docs, items


SMALL = decontamination.Settings(piece=4, block_windows=40)


@pytest.mark.parametrize("how", [decontamination.Settings(), SMALL])
def test_against_all_windows(spark, how):
    docs, items = corpus()
    want = by_hand(docs, items)
    assert found(spark, docs, items, how) == want
    assert sum(r[5] for r in want) > 10 and sum(not r[5] for r in want) > 10


@pytest.mark.parametrize("how", [decontamination.Settings(), SMALL])
def test_odd_rows(spark, how):
    long = " ".join(f"w{i}" for i in range(25))
    items = [(1, long), (1, long), (10, long + " more"), (2, None), (3, ""), (4, "..."), (None, "only three words"), (5, "Straße 5 ÄB")]
    docs = [(None, None), (None, "see: ONLY three-words"), (2**60 + 1, ""), (2**60 + 2, "!!"), (7, long), (7, long), (8, "straße 5 Äb"), (9, "strasse 5 äb"), (10, "w0 " * 50_000 + long), (11, "\x00w1 w2 w3")]
    docs += [(100 + i, long.replace("w9 ", "other ") + " " + long) for i in range(40)]
    assert found(spark, docs, items, how) == by_hand(docs, items)
    assert found(spark, docs, [], how) == by_hand(docs, []) and found(spark, [], items, how) == []


def test_pieces_cover_every_window_once(spark):
    items = [(i, " ".join(f"{i}w{j}" for j in range(n))) for i, n in enumerate([0, 1, 9, 10, 11, 13, 14, 40])]
    rows = decontamination.pieces(spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS), decontamination.Settings(piece=4)).collect()
    got = [tuple(r["words"][k : k + 10]) for r in rows for k in range(r["windows"])]
    want = [tuple(w[k : k + 10]) for _, t in items if (w := t.split()) for k in range(max(len(w) - 9, 1))]
    assert sorted(got) == sorted(want)
