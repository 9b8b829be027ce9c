from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from panelcast.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, rank int, term string"


def by_hand(rows, how):
    words, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        words[lang, source].update(found)
        seen[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= how.least_documents]
        of = lambda counts: (lambda n: {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept})(sum(counts[t] for t in kept))
        own, f = of(words[lang, source]), lambda p, q: (p - q) ** 2 // q
        others = [(-sum(f(own[t], q[t]) for t in kept), s.encode()) for m, s in groups if m == lang and s != source for q in [of(words[lang, s])]]
        whole = of(sum((words[g] for g in groups if g[0] == lang), Counter()))
        more = [(-f(own[t], whole[t]), t.encode()) for t in kept if words[lang, source][t] and own[t] > whole[t]]
        out += [(lang, source, "pair", s.decode(), -v, k + 1) for k, (v, s) in enumerate(sorted(others))]
        out += [(lang, source, "term", s.decode(), -v, k + 1) for k, (v, s) in enumerate(sorted(more)[: how.top])]
    return sorted(out)


def found(spark, rows, how):
    out = divergence.audit(spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).repartition(3), how)
    return sorted(tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect())


def texts(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        lang, source = rng.choice("ab"), f"s{min(int(rng.expovariate(0.6)), 6)}"
        out.append((i, " ".join(f"w{chr(97 + min(int(rng.expovariate(0.15)), 25))}{chr(97 + rng.randrange(3))}" for _ in range(rng.randrange(60))), lang, source))
    return out


@pytest.mark.parametrize("how", [divergence.Settings(), divergence.Settings(cells=40, columns=24, terms=8, held=20, top=5)])
def test_against_plain_sums(spark, how):
    rows = texts(120, 1)
    want = by_hand(rows, how)
    assert found(spark, rows, how) == want and len({r[0] for r in want}) == 2


def test_odd_rows(spark):
    how = divergence.Settings()
    rows = [(i, "Äpfel und BIRNEN und\x00x9y", "de", s) for i, s in enumerate(["a", "a", "a", None, "", "é"])]
    rows += [(None, None, "de", "z"), (None, "", None, None), (7, "a b", "x", "only"), (7, "a b", "y", "p"), (8, "c", "y", "q"), (9, "lone " * 20_000, "de", "a")]
    want = by_hand(rows, how)
    assert found(spark, rows, how) == want
    assert ("y", "p", "pair", "q", 0, 1) in want and not [r for r in want if r[0] in ("x", "")] and [r for r in want if r[1] == "z"]
    assert found(spark, [], how) == []


def test_counts_of_one_hot_source(spark):
    """A term with a count past 32 bits' rate product, and equal values in the order of their bytes."""
    rows = [(i, "aa bb ö z " * (3_000 if i == 0 else 1), "l", "hot" if i < 3 else f"s{i}") for i in range(8)]
    assert found(spark, rows, divergence.Settings(columns=8)) == by_hand(rows, divergence.Settings())


def test_rates_beyond_longs(spark):
    frame = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "n long, total long, terms long")
    assert frame.select(divergence._rate("n", "total", "terms")).first()[0] == 1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 7)
    assert frame.select(divergence._rate("n", "total - total", "terms - terms")).first()[0] is None
