from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import rp_forest

SCHEMA = "vec_id long, embedding array<float>, score int"


def exact(x, ids, k=20):
    out = {}
    for i, q in enumerate(ids):
        if q % 20 == 0:
            scores = (x * x[i]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -scores)) if j != i][:k]
            out[int(q)] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)).astype(np.float32).astype(float)
    if scaled:
        x = (x * rng.uniform(0.2, 3, size=(3000, 1))).astype(np.float32).astype(float)
    ids = np.arange(3000)
    want = exact(x, ids)
    how = rp_forest.Settings(leaf_rows=64, block=700)
    got = found(rp_forest.neighbours(spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], SCHEMA), F.col("vec_id") % 20 == 0, how))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
    scores = {q: dict(v) for q, v in want.items()}
    assert all(scores[q].get(i, s) == pytest.approx(s, abs=1e-12) for q, v in got.items() for i, s in v)


def test_clustered_vectors_need_few_leaves(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(60, 32))[rng.integers(0, 60, 4000)] + 0.15 * rng.normal(size=(4000, 32))).astype(np.float32).astype(float)
    ids, seen = np.arange(4000), []
    inner = rp_forest._enough
    monkeypatch.setattr(rp_forest, "_enough", lambda *a: seen.append(inner(*a)) or seen[-1])
    got = found(rp_forest.neighbours(spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], SCHEMA), F.col("vec_id") % 20 == 0, rp_forest.Settings(leaf_rows=32, sample_rows=2000)))
    want = exact(x, ids)
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert seen[0] < 0.4 * 4000  # with repeats: a tenth of the table in each of four trees


def test_small_tables_are_exact_with_ties(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(30)] + [(100 + i, [0.5, float(i)], 0) for i in range(5)]
    bad = [(40, None, 0), (60, [0.0, 0.0], 0), (80, [1.0, None], 0), (120, [float("nan"), 1.0], 0), (None, [1.0, 1.0], 0), (140, [float("inf"), 1.0], 0), (160, [], 0), (180, [1.0], 0), (20, [1.0, 0.0], 0)]
    got = found(rp_forest.neighbours(spark.createDataFrame(rows + bad, SCHEMA), F.col("vec_id") % 20 == 0, rp_forest.Settings(block=4)))
    x, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    assert got == exact(x, ids)


def test_few_and_none(spark):
    got = found(rp_forest.neighbours(spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [2.0, 0.5], 0)], SCHEMA), F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 3.0)]}
    assert rp_forest.neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
    assert found(rp_forest.neighbours(spark.createDataFrame([(0, [1.0], 0)], SCHEMA), F.col("vec_id") % 20 == 0)) == {}


def test_rows_of_groups_follow_the_table(spark, monkeypatch):
    """Without structure nearly all leaves are reached; what the groups give still grows with the queries alone."""
    inner, how, given = rp_forest._search, rp_forest.Settings(leaf_rows=16, sample_rows=2000, block=100, parts=3), []
    x = np.random.default_rng(3).normal(size=(2000, 16)).astype(np.float32).astype(float)
    for n in (400, 2000):
        rows = spark.sparkContext.accumulator(0)

        def search(k, rows=rows):
            work = inner(k)

            def counted(batches):
                for out in work(batches):
                    rows.add(len(out))
                    yield out

            return counted

        monkeypatch.setattr(rp_forest, "_search", search)
        got = found(rp_forest.neighbours(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x[:n])], SCHEMA), F.col("vec_id") % 20 == 0, how))
        want = exact(x[:n], np.arange(n))
        assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
        given.append(rows.value)
    assert given[0] <= 3 * 20 * 20 and given[1] <= 3 * 20 * 100
