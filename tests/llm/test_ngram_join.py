from __future__ import annotations

import random
import re

import pytest

from panelcast.llm import ngram_join

SCHEMA = "doc_id long, text string, lang string"


def brute_force(rows):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
    label = {d: d for d in sets}
    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    return {d: (len(sets[d]), label[d]) for d in docs}


def near_copies(seed, bases=4, copies=25):
    random.seed(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for _ in range(bases):
        base = [f"w{random.randrange(400)}" for _ in range(random.choice([3, 9, 12, 20, 60, 150, 400]))] + passage * (random.random() < 0.5)
        for _ in range(copies):
            words = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3, 8])):
                at = random.randrange(len(words))
                words[at : at + 1] = random.choice([["new"], [], ["A", "b"], [f"x{random.randrange(9)}"]])
            rows.append((len(rows) + 1, " ".join(words)))
    return rows


def compare(spark, rows):
    got = ngram_join.groups(spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_force(rows)


@pytest.mark.parametrize("seed", range(3))
def test_near_copies(spark, seed):
    compare(spark, near_copies(seed))


def test_split_clusters(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    compare(spark, near_copies(11, bases=3, copies=30))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one"), (7, "one two three"), (8, "é É"), (9, "É É"), (10, "a b c d " * 2000), (11, "a b c d " * 2000 + "e")]
    compare(spark, rows)


def test_empty_and_repeats(spark):
    assert ngram_join.groups(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(5, "a b c d", "x"), (5, "a b c d", "x"), (3, "a b c d", "y"), (None, "a b c d", "z"), (None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["component_id"] for r in ngram_join.groups(docs).where("doc_id is not null").collect()) == [3, 3, 3]
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 3), (True, 0), (True, 0)]


def test_one_doc_id_with_several_texts(spark):
    """Such a document links with whatever any of its texts links with; each row has the size of its own set."""
    rows = near_copies(21, bases=5, copies=8)
    rows += [(3, rows[12][1]), (3, rows[12][1] + " more"), (25, "a text of its own"), (38, rows[1][1])]
    got = ngram_join.groups(spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA)).collect()
    alone = brute_force(list(enumerate(t for _, t in rows)))
    label = {d: d for d, _ in rows}
    owner = [d for d, _ in rows]
    for i, (_, c) in alone.items():
        low, high = sorted((label[owner[i]], label[owner[c]]))
        label = {d: low if x == high else x for d, x in label.items()}
    want = sorted((d, alone[i][0], label[d] if t else d) for i, (d, t) in enumerate(rows))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_signatures_meet():
    """Linked sets share a signature, at the tightest sizes too."""
    import numpy as np

    random.seed(5)
    for _ in range(1500):
        a = random.randint(9, 300)
        sets = random.sample(range(1 << 62), a + a // 9)
        d = a // 9
        swap = random.randint(0, d // 2)
        grow = d - 2 * swap if random.random() < 0.7 else 0
        one, two = sets[:a], sets[swap : a + swap + grow]
        both = len(set(one) & set(two))
        if one != two and 100 * both >= 90 * len(set(one) | set(two)):
            s, t = (set(ngram_join.signatures(np.sort(np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15))).tolist()) for x in (one, two))
            assert s & t
