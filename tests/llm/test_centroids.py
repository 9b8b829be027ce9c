from __future__ import annotations

import hashlib

import numpy as np
import pytest

from panelcast.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string"


def by_hand(rows, how):
    """Plain k-means in whole numbers, over Python's own integers."""
    kept = [(i, [int(np.floor(how.scale * float(np.float32(v)))) for v in e]) for i, e in rows if e is not None and len(e) == how.components and all(v is not None and np.isfinite(v) and abs(v) < centroids.LARGEST / how.scale for v in e)]
    hashed = sorted((hashlib.sha256(f"{how.seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centres = [x for _, x in hashed[: how.clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centres))

    for _ in range(how.rounds):
        told = [nearest(x)[1] for _, x in kept]
        for k in range(len(centres)):
            mine = [x for (_, x), t in zip(kept, told) if t == k]
            if mine:
                centres[k] = [sum(column) // len(mine) for column in zip(*mine)]
    out = [(i, *nearest(x)) for i, x in kept] if centres else []
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i if i is not None else -1, k, d, sum(e for _, e, m in out if m == k), sum(e for _, e, _ in out), digest[k]) for i, d, k in out)


def found(spark, rows, how):
    out = centroids.clusters(spark.createDataFrame([(i, e, 0, "x") for i, e in rows], SCHEMA).repartition(3), how)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, *r[1:]) for r in out.collect())


@pytest.mark.parametrize("kind", ["normal", "grid", "equal"])
def test_against_plain_search(spark, kind):
    how, rng = centroids.Settings(clusters=7, components=6), np.random.default_rng(3)
    x = {"normal": rng.normal(size=(300, 6)), "grid": rng.integers(-1, 2, size=(300, 6)) / 64, "equal": np.zeros((300, 6))}[kind]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(spark, rows, how) == by_hand(rows, how)


def test_nulls_repeats_and_few_vectors(spark):
    how = centroids.Settings(clusters=3, components=2)
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [0.25, -1.0]), (None, [3.0, 3.0]), (3, [-0.01, 0.0]), (4, [1.0, -1.0])]
    bad = [(5, None), (6, []), (7, [1.0]), (8, [1.0, None]), (9, [float("nan"), 0.0]), (10, [float("inf"), 0.0]), (11, [1.0, 2.0, 3.0]), (12, [3e38, 0.0])]
    assert found(spark, rows + bad, how) == by_hand(rows, how) and len(by_hand(rows, how)) == 6
    assert found(spark, rows[:2], how) == by_hand(rows[:2], how)
    assert found(spark, bad, how) == [] and found(spark, [], how) == [] and found(spark, rows[3:4], how) == []


def test_search_is_exact_and_rejects(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-60, 60, size=(40, 16)) + rng.integers(-200, 200, size=(40, 1))
    x = base[rng.integers(0, 40, 2000)] + rng.integers(-3, 4, size=(2000, 16))
    number, distance, measured = centroids.Search(base).nearest(x)
    full = ((x[:, None] - base[None]) ** 2).sum(axis=2)
    assert (number == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert measured < 0.3 * 2000 * 40
    far = np.array([[centroids.LARGEST - 1] * 64, [1 - centroids.LARGEST] * 64])
    number, distance, _ = centroids.Search(far[::-1].copy()).nearest(np.r_[far, -far])
    assert number.tolist() == [1, 0, 0, 1] and distance.tolist() == [0, 0, 0, 0]
