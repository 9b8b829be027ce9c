from __future__ import annotations

import random

import numpy as np

from panelcast.llm import substring_chains as sc

SCHEMA = "doc_id long, text string, start string, home_id string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_edits():
    random.seed(1)
    for _ in range(400):
        a = [random.randrange(4) for _ in range(random.randrange(random.choice([30, 90])))]
        b = list(a)
        for _ in range(random.randrange(6)):
            at = random.randrange(len(b) + 1)
            b[at : at + random.randrange(2)] = [random.randrange(4)] * random.randrange(3)
        assert sc.edits(np.array(a, np.uint32), np.array(b, np.uint32)) == distance(a, b)
    for _ in range(60):
        a, b = ([random.randrange(5) for _ in range(random.randrange(20, 130))] for _ in range(2))
        want, limit = distance(a, b), random.randrange(5, 80)
        assert sc.edits(np.array(a, np.uint32), np.array(b, np.uint32)) == want
        got = sc.edits(np.array(a, np.uint32), np.array(b, np.uint32), limit)
        assert got == want if want <= limit else got > limit


def test_chains_against_quadratic():
    random.seed(2)
    for _ in range(200):
        matches = sorted({(random.randrange(60), random.randrange(60)) for _ in range(random.randrange(1, 25))})
        best = []
        for j, (p, h) in enumerate(matches):
            best.append(sc.GAIN + max([0.0, *(best[i] - sc.GAP * (p - q + h - g) for i, (q, g) in enumerate(matches[:j]) if q < p and g < h)]))
        found = sc.chains([p for p, _ in matches], [h for _, h in matches])
        for c in found:
            assert all(matches[a][0] < matches[b][0] and matches[a][1] < matches[b][1] for a, b in zip(c, c[1:]))
        if max(best) > sc.GAIN:
            c = found[0]
            a, b = matches[c[0]], matches[c[-1]]
            assert abs(sc.GAIN * len(c) - sc.GAP * (b[0] - a[0] + b[1] - a[1]) - max(best)) < 1e-9


def test_passages(spark):
    random.seed(3)
    prose = lambda n: [f"w{random.randrange(5000)}" for _ in range(n)]
    passage = prose(55)
    fuzzy = list(passage)
    for at in (11, 30):
        fuzzy[at : at + 1] = ["changed", "twice"]
    whole = prose(300)
    near = whole[:100] + ["x"] + whole[101:200] + whole[203:]
    first, second = prose(60), prose(60)
    rows = {
        1: prose(80) + passage + prose(80), 2: prose(20) + passage, 3: passage + prose(200), 4: prose(90) + fuzzy + prose(9),
        5: whole, 6: near, 7: list(whole), 8: prose(400), 9: prose(40), 10: first, 11: second, 12: prose(7) + first[20:] + second[:40] + prose(9),
    }
    data = [(k, " ".join(v), "a", "b") for k, v in rows.items()] + [(None, " ".join(whole), "", ""), (13, None, "", ""), (14, "", "", ""), (9, " ".join(rows[9]), "", "")]
    got = sc.passages(spark.createDataFrame(data, SCHEMA)).collect()
    pairs = {(r["doc_id"], r["home_id"]) for r in got}
    assert pairs == {(2, 1), (3, 1), (4, 1), (6, 5), (7, 5), (12, 10), (12, 11)}
    for r in got:
        one, two = rows[r["doc_id"]][r["start"] : r["stop"]], rows[r["home_id"]][r["home_start"] : r["home_stop"]]
        assert distance(one, two) == r["edits"] and r["similarity"] >= 0.8
    spans = {(r["doc_id"], r["home_id"]): (r["start"], r["stop"]) for r in got}
    assert spans[2, 1][0] == 20 and spans[2, 1][1] >= 75 and spans[7, 5] == (0, 300) and spans[6, 5] == (0, len(near))


def test_parts_against_brute_force():
    random.seed(4)

    def brute(low, high, places, homes, wrong):
        if low > high:
            return []
        words = lambda i, j: sum(max(places[k + 1] - places[k], homes[k + 1] - homes[k]) for k in range(i, j)) + sc.K
        good = [(places[j] - places[i] + homes[j] - homes[i], i, j) for i in range(low, high + 1) for j in range(i, high + 1) if words(i, j) >= 5 * sum(wrong[i:j])]
        _, i, j = max(good)
        return [*brute(low, i - 1, places, homes, wrong), (i, j), *brute(j + 1, high, places, homes, wrong)]

    for _ in range(300):
        n = random.randrange(1, 12)
        places, homes, wrong = [0], [0], []
        for _ in range(n - 1):
            a, b = random.randrange(1, 40), random.randrange(1, 40)
            places.append(places[-1] + a), homes.append(homes[-1] + b), wrong.append(random.choice([0, abs(a - b), max(a, b)]))
        got = sc.parts(places, homes, wrong)
        # Of equally long parts either may be taken: lengths are compared where all sums differ.
        want = brute(0, n - 1, places, homes, wrong)
        assert max(places[j] - places[i] + homes[j] - homes[i] for i, j in got) == max(places[j] - places[i] + homes[j] - homes[i] for i, j in want)
        assert sorted(k for i, j in got for k in range(i, j + 1)) == list(range(n))


def test_two_passages_with_unlike_text_between(spark):
    random.seed(5)
    prose = lambda n: [f"w{random.randrange(50000)}" for _ in range(n)]
    data, spans = [], {}
    for k, (length, gap) in enumerate([(60, 40), (60, 100), (60, 300), (200, 300), (1000, 700)]):
        first, second = prose(length), prose(length)
        data += [(2 * k, " ".join(first + prose(gap) + second), "", ""), (2 * k + 1, " ".join(prose(5) + first + prose(gap) + second + prose(5)), "", "")]
        spans[2 * k + 1, 2 * k] = {(5, 5 + length), (5 + length + gap, 5 + 2 * length + gap)}
    got = {}
    for r in sc.passages(spark.createDataFrame(data, SCHEMA)).collect():
        got.setdefault((r["doc_id"], r["home_id"]), set()).add((r["start"], r["stop"]))
    assert got == spans


def test_lengthened_against_quadratic():
    random.seed(6)
    for _ in range(100):
        one = [random.randrange(6) for _ in range(random.randrange(9))]
        two = [random.randrange(6) for _ in range(random.randrange(9))]
        worth, words, wrong = (x[0] for x in sc.lengthened([np.array(one, np.uint32)], [np.array(two, np.uint32)]))
        for i in range(1, len(one) + 1):
            values = [max(i, j) - 5 * distance(one[:i], two[:j]) for j in range(1, len(two) + 1) if one[i - 1] == two[j - 1]]
            assert worth[i] == max(values) and distance(one[:i], two[: words[i]]) == wrong[i] if values else worth[i] < -1000


def test_recall_of_substituted_passages(spark):
    """Pairs that differ by random substitutions of words; a passage is found if most of its words are reported."""
    random.seed(7)
    prose = lambda n: [f"w{random.randrange(50000)}" for _ in range(n)]
    data, planted = [], {}
    for length, similarity in [(36, 0.95), (36, 0.9), (50, 0.9), (50, 0.85), (50, 0.82), (60, 0.85), (60, 0.82), (100, 0.82)]:
        for _ in range(40):
            passage = prose(length)
            other = list(passage)
            for at in random.sample(range(1, length - 1), int(length * (1 - similarity) + 1e-9)):
                other[at] = "changed" + str(random.randrange(50000))
            k = len(data)
            data += [(k, " ".join(prose(50) + passage + prose(50)), "", ""), (k + 1, " ".join(prose(70) + other + prose(9)), "", "")]
            planted[k + 1, k] = (length, similarity)
    got = {}
    for r in sc.passages(spark.createDataFrame(data, SCHEMA)).collect():
        length, _ = planted[r["doc_id"], r["home_id"]]
        if min(r["stop"], 70 + length) - max(r["start"], 70) >= length / 2:
            got[r["doc_id"], r["home_id"]] = planted[r["doc_id"], r["home_id"]]
    recall = {c: list(got.values()).count(c) / 40 for c in planted.values()}
    print(recall)
    assert min(recall.values()) >= 0.9


def test_homes_that_hold_parts_only(spark):
    """Documents 1 and 2 quote the halves of what 3 and 4 hold whole; 11 to 39 begin or end as 40 and 41 do."""
    random.seed(8)
    prose = lambda n: [f"w{random.randrange(50000)}" for _ in range(n)]
    passage, other = prose(50), prose(40)
    rows = {1: prose(30) + passage[:25] + prose(30), 2: prose(9) + passage[25:] + prose(60), 3: prose(20) + passage + prose(20), 4: prose(50) + passage + prose(7)}
    for k in range(11, 40):
        rows[k] = prose(20) + (other[:20] if k % 2 else other[20:]) + prose(20)
    fuzzy = other[:19] + ["x", "y"] + other[21:]  # no combination of two seeds goes over the middle
    rows |= {40: prose(30) + other + prose(3), 41: prose(3) + fuzzy + prose(30)}
    got = sc.passages(spark.createDataFrame([(k, " ".join(v), "", "") for k, v in rows.items()], SCHEMA)).collect()
    assert {(r["doc_id"], r["home_id"]): (r["start"], r["stop"]) for r in got} == {(4, 3): (50, 100), (41, 40): (3, 43)}


def test_decoys_before_a_passage(spark):
    """Documents with each five words of a passage, or each ten, come first: the passage is found all the same."""
    random.seed(12)
    prose = lambda n: [f"w{random.randrange(50000)}" for _ in range(n)]
    one, two = prose(120), prose(120)
    texts = [prose(3) + one[i : i + 5] + prose(3) for i in range(116)] + [prose(3) + two[i : i + 14] + prose(3) for i in range(107)]
    k = len(texts)
    texts += [prose(20) + one + prose(9), prose(5) + one + prose(50), prose(20) + two + prose(9), prose(5) + two + prose(50)]
    got = sc.passages(spark.createDataFrame([(i, " ".join(v), "", "") for i, v in enumerate(texts)], SCHEMA)).collect()
    assert {(r["doc_id"], r["home_id"]) for r in got} == {(k + 1, k), (k + 3, k + 2)}


def test_random_corpora_against_brute_force(spark):
    """Every run of equal words that is long enough is in a reported passage of the later document, though sentences
    that many documents share stand all around; and what is reported is a passage."""
    random.seed(13)
    prose = lambda n: [f"w{random.randrange(3000)}" for _ in range(n)]
    common = [prose(random.randrange(8, 25)) for _ in range(12)]
    passages = [prose(random.randrange(50, 90)) for _ in range(6)]
    texts = []
    for _ in range(90):
        words = []
        for _ in range(random.randrange(2, 7)):
            words += prose(random.randrange(15)) + random.choice(common)
            if random.random() < 0.25:
                p = random.choice(passages)
                words += p[random.randrange(12) : len(p) - random.randrange(12)]
        texts.append(words)
    got = sc.passages(spark.createDataFrame([(i, " ".join(v), "", "") for i, v in enumerate(texts)], SCHEMA)).collect()
    for r in got:
        one, two = texts[r["doc_id"]][r["start"] : r["stop"]], texts[r["home_id"]][r["home_start"] : r["home_stop"]]
        assert min(len(one), len(two)) >= 30 and distance(one, two) == r["edits"] and r["edits"] <= 0.2 * max(len(one), len(two)) + 1e-9
    certain = sc.LEAST_WORDS + 2 * (sc.K + sc.WINDOW)
    seen, runs = {}, 0
    for i, words in enumerate(texts):
        mine = [(r["start"], r["stop"]) for r in got if r["doc_id"] == i]
        for p in range(len(words) - certain + 1):
            gram = tuple(words[p : p + certain])
            if seen.setdefault(gram, i) != i:
                runs += 1
                assert any(min(b, p + certain) - max(a, p) >= 20 for a, b in mine)
    assert runs > 100


def test_one_doc_id_with_several_texts(spark):
    random.seed(14)
    prose = lambda n: " ".join(f"w{random.randrange(50000)}" for _ in range(n))
    one, two = prose(60), prose(60)
    rows = [(1, one), (1, two), (1, two), (5, prose(9) + " " + one), (6, two + " " + prose(9)), (7, None), (7, None)]
    got = sc.passages(spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA)).collect()
    assert {tuple(sorted((r["doc_id"], r["home_id"]))) for r in got} == {(1, 5), (1, 6)}


def test_one_word_over_and_over(spark):
    random.seed(10)
    prose = lambda n: [f"w{random.randrange(50000)}" for _ in range(n)]
    rows = [prose(20) + ["same"] * 300 + prose(9), prose(7) + ["same"] * 240 + prose(30)]
    got = sc.passages(spark.createDataFrame([(k, " ".join(v), "", "") for k, v in enumerate(rows)], SCHEMA)).collect()
    assert [(r["start"], r["stop"], r["edits"]) for r in got] == [(7, 247, 0)]


def test_empty(spark):
    assert sc.passages(spark.createDataFrame([], SCHEMA)).collect() == []
    assert sc.passages(spark.createDataFrame([(1, "a " * 500, "", ""), (2, "b", "", "")], SCHEMA)).collect() == []


def test_matches_in_order_need_no_tree(monkeypatch):
    """Near matches in order in both texts are one chain, told without the tree; a wide gap or a step back is not."""
    made, inner = [], sc.Fenwick
    monkeypatch.setattr(sc, "Fenwick", lambda n: made.append(n) or inner(n))
    near = [3 * i for i in range(50)]
    assert sc.chains(near, [p + 7 + (p > 60) for p in near]) == [list(range(50))] and not made
    assert sc.chains([0, 200], [0, 200]) == [[0], [1]] and len(made) == 1
    assert sc.chains([0, 3, 6], [9, 3, 6]) == [[1, 2], [0]] and len(made) == 2


def test_minimizers_of_texts_laid_end_to_end():
    """As each text's own, with few different hashes and texts of no, few and many of them."""
    rng = np.random.default_rng(7)
    counts = rng.integers(0, 12, 300)
    hashes = rng.integers(0, 4, counts.sum()).astype(np.uint64) - np.uint64(1)
    want, low = [], 0
    for text, n in enumerate(counts.tolist()):
        own = hashes[low : low + n].tolist()
        low += n
        at = {min(range(i, min(i + sc.WINDOW, n)), key=lambda j: (own[j], j)) for i in range(max(1, n - sc.WINDOW + 1))} if n else set()
        want += [(text, j) for j in sorted(at)]
    assert list(zip(*(v.tolist() for v in sc.minimizers(hashes, counts)))) == want


def test_edits_of_one_length_against_quadratic():
    rng = np.random.default_rng(8)
    for _ in range(300):
        one = rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint32)
        two = one.copy() if rng.random() < 0.7 else rng.integers(0, 4, len(one)).astype(np.uint32)
        two[rng.integers(0, len(two), 2)] = rng.integers(0, 4, 2)
        row = list(range(len(two) + 1))
        for i, x in enumerate(one.tolist(), 1):
            corner, row[0] = row[0], i
            for j, y in enumerate(two.tolist(), 1):
                corner, row[j] = row[j], min(corner + (x != y), row[j] + 1, row[j - 1] + 1)
        assert sc.edits(one, two) == row[-1]
