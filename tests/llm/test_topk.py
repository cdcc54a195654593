"""Operator 9 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import topk


def brute(rows, k=5):
    good = [(i, np.floor(256 * np.array(v + [0.0] * (8 - len(v)))).astype(int)) for i, v in rows if i is not None and v and not any(x is None or x != x for x in v)]
    pool = {}
    for i, q in good:
        if i % 50 == 0:
            pool.setdefault(i, []).extend((-int(q @ v), j) for j, v in good if j != i)
    return sorted((q, r + 1, i, -s) for q, p in pool.items() for r, (s, i) in enumerate(sorted(p)[:k]))


@pytest.mark.parametrize(("small", "dense"), [(False, 0.05), (True, 0.05), (True, 2.0)])
def test_repeated_rows_ties_and_odd_vectors(spark, monkeypatch, small, dense):
    monkeypatch.setattr(topk, "DENSE", dense)
    if small:
        for name, value in (("QUERIES", 3), ("CHUNK", 7), ("SEEDS", 6), ("STEP", 4)):
            monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).tolist()) for i in range(200)]
    rows += [(7, rows[7][1])] * 5 + [(50, rows[50][1])] * 2 + [(50, rows[3][1]), (100, rows[9][1])]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [1.0, None] * 4), (304, [float("nan")] * 8), (None, [1.0] * 8), (305, [0.0] * 8), (350, [0.0] * 8), (306, [9.0] * 3), (307, [])]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute([r for r in rows if r[1] != []] + [(307, [0.0] * 8)])


def test_few_rows(spark):
    rows = [(0, [1.0, 2.0] * 4), (1, [3.0] * 8), (50, [2.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 50 == 0).collect())) == brute(rows)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(frame.where("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0
