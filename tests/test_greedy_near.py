"""Greedy matches by growing radii, against the plain walk over all pairs by distance."""

import math
import random

from framestack.operators import joins


def test_growing_radii_against_the_walk(spark, monkeypatch):
    pick = random.Random(5)
    points = [[(k, i, round(pick.gauss(0, 1), 2), round(pick.gauss(0, 1), 2)) for k in "pq" for i in range(250)] for _ in range(2)]
    a, b = (spark.createDataFrame(p, "label string, vec_id long, x double, y double") for p in points)
    seen, plain = [], joins.radius_pairs
    monkeypatch.setattr(joins, "radius_pairs", lambda *args: seen.append(plain(*args)) or seen[-1])
    got = {(r.label, r.left_id, r.right_id) for r in joins.greedy_near(a, b, ["label"], "vec_id", "vec_id", "x", "y", 0.5).collect()}
    pairs = [(math.sqrt((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2), p[0], p[1], q[1]) for p in points[0] for q in points[1] if p[0] == q[0]]
    want, left, right = set(), set(), set()
    within = sorted(p for p in pairs if p[0] <= 0.5)
    for _, k, i, j in within:
        if (k, i) not in left and (k, j) not in right:
            want.add((k, i, j))
            left.add((k, i))
            right.add((k, j))
    assert got == want
    assert sum(df.count() for df in seen) < len(within) / 2
