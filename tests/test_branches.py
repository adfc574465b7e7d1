"""Side channels: cheapest ways, and an arm beside a river."""

import itertools

import numpy as np
import pytest

from tarn.operators import branches


def test_cheapest_ways_against_all():
    rng = np.random.default_rng(3)
    for _ in range(5):
        cost = rng.uniform(0.1, 2, (4, 4))
        cost[rng.integers(4), rng.integers(1, 4)] = np.inf
        cost[0, 0], target = 1.0, np.zeros((4, 4), bool)
        target[3, 3] = True
        cost[3, 3] = 1.0
        best = np.full((4, 4), np.inf)
        best[0, 0] = 0
        for _ in range(20):  # relaxation
            for r, c, a, b in itertools.product(range(4), range(4), (-1, 0, 1), (-1, 0, 1)):
                if 0 <= r + a < 4 and 0 <= c + b < 4:
                    best[r + a, c + b] = min(best[r + a, c + b], best[r, c] + np.hypot(a, b) * (cost[r, c] + cost[r + a, c + b]) / 2)
        way = branches.cheapest_path(cost, (0, 0), target)
        price = sum(np.hypot(*(q - p)) * (cost[tuple(p)] + cost[tuple(q)]) / 2 for p, q in itertools.pairwise(way))
        assert price == pytest.approx(best[3, 3])
    shut = np.ones((3, 3))
    shut[1] = np.inf
    target = np.zeros((3, 3), bool)
    target[2, 2] = True
    assert len(branches.cheapest_path(shut, (0, 0), target)) == 0


def arm():
    """A river along row 20, and a mapped arm that leaves it at column 10 and is back at column 50."""
    drawn = {(r, c) for r in range(18, 23) for c in range(60)}
    area = set(drawn)
    for c in range(10, 51):
        middle = 20 + int(round(12 * np.sin((c - 10) / 40 * np.pi)))
        area |= {(r, c) for r in range(middle - 3, middle + 4)}
    return area, drawn


def cells(spark, places, **more):
    names = ", ".join(["row int, col int", *(f"{k} int" for k in more)])
    return spark.createDataFrame([(int(r), int(c), *more.values()) for r, c in sorted(places)], names)


def river(spark):
    rows = [(1, c, 20.0, float(c), 10.0, float(5 * (59 - c)), 1, False) for c in range(60)]
    return spark.createDataFrame(rows, "seg_id long, ord int, row double, col double, half_width double, position double, sink long, wet boolean")


def test_an_arm_becomes_a_channel(spark):
    area, drawn = arm()
    lakes = spark.createDataFrame([], "row int, col int, lake_id int")
    none = spark.createDataFrame([], "seg_id long, ord int, lake_id int")
    line, said = branches.side_channels(cells(spark, area), cells(spark, drawn), lakes, river(spark), none, 60, 5.0)
    decided = said.collect()
    assert len(decided) == 1 and decided[0].why is None and decided[0].rejoin_id == 1 and decided[0].ord < 14 and decided[0].rejoin_ord > 46
    points = line.orderBy("ord").collect()
    assert points[0].col < 16 and points[-1].col > 44 and max(p.row for p in points) > 28
    assert 15 < np.median([p.width for p in points]) < 60


def test_a_channel_into_a_lake_and_pieces_without_one(spark):
    drawn = {(r, c) for r in range(18, 23) for c in range(60)}
    area = drawn | {(r, c) for r in range(23, 50) for c in range(28, 34)} | {(r, c) for r in range(2, 5) for c in range(2, 5)}
    lakes = cells(spark, {(r, c) for r in range(50, 56) for c in range(20, 45)}, lake_id=7)
    below = spark.createDataFrame([(1, k, 7) for k in range(60)], "seg_id long, ord int, lake_id int")
    line, said = branches.side_channels(cells(spark, area), cells(spark, drawn), lakes, river(spark), below, 60, 5.0)
    assert [(r.lake_id, r.why) for r in said.collect()] == [(7, None)]
    points = line.orderBy("ord").collect()
    assert points[-1].row > 50
    upstream = branches.side_channels(cells(spark, area), cells(spark, drawn), lakes, river(spark), below.limit(0), 60, 5.0)[1]
    assert [r.why for r in upstream.collect()] == ["lake_upstream"]
    alone = branches.side_channels(cells(spark, area), cells(spark, drawn), lakes.limit(0), river(spark), below.limit(0), 60, 5.0)
    assert [r.why for r in alone[1].collect()] == ["one_contact"] and alone[0].count() == 0
