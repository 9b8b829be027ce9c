from __future__ import annotations

import random

import pytest

from panelcast.operators.selection import counted, order_statistics


@pytest.mark.parametrize(("bins", "small"), [(2, 0), (7, 50), (64, 0), (64, 4_096)])
def test_order_statistics(spark, bins, small):
    """Against sorting: ties, one hot value, heavy tails, tiny groups, ranks past the end."""
    rng = random.Random(1)
    groups = {
        "even": [rng.random() for _ in range(300)],
        "ties": [float(rng.randrange(4)) for _ in range(200)],
        "hot": [0.0] * 150 + [rng.gauss(0, 1) for _ in range(50)],
        "tails": [10.0 ** rng.uniform(-200, 200) for _ in range(100)],
        "one": [2.5],
        "infinite": [float("inf"), -float("inf"), 0.0],
    }
    rows = [(g, v, i) for g, vs in groups.items() for i, v in enumerate(vs)] + [("even", None, -1), ("null", None, -1)]
    df = spark.createDataFrame(rows, "g string, x double, i int").repartition(3)
    ranks = [(g, r) for g, vs in groups.items() for r in {0, 1, len(vs) // 2, len(vs) // 4, len(vs) - 2, len(vs) - 1, len(vs), 10_000}]
    got = {(r["g"], r["rank"]): r["value"] for r in order_statistics(counted(df, ["g"], "x"), spark.createDataFrame(ranks, "g string, rank long"), ["g"], bins, small).collect()}
    assert got == {(g, r): sorted(groups[g])[r] for g, r in ranks if 0 <= r < len(groups[g])}
