"""Mouths, riffles, low ground beside lakes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import mouths, shores


def scene(spark, outlet_bank=12.0):
    """A lake of level 10 with a flat bed at 8 and its ring at 10; a river comes in from the west and goes out in the east."""
    n = 41
    h, kind = np.full((n, n), outlet_bank + 3), np.zeros((n, n), int)
    kind[10:31, 10:31], h[10:31, 10:31] = 2, 8.0
    for r in range(10, 31):
        for c in range(10, 31):
            if r in (10, 30) or c in (10, 30):
                h[r, c] = 10.0
    kind[20, :10], h[20, :10] = 1, np.linspace(10.4, 9.4, 10)
    kind[20, 31:], h[20, 31:] = 1, np.linspace(9.3, 8.0, 10)
    h[19:22, 31:34] = np.where(kind[19:22, 31:34] == 1, h[19:22, 31:34], outlet_bank)
    rows = [(r, c, float(h[r, c]), int(kind[r, c]), int(kind[r, c] == 2), False) for r in range(n) for c in range(n)]
    cells = spark.createDataFrame(rows, "row int, col int, h double, kind int, lake_id int, island boolean")
    made = spark.createDataFrame([(1, "inflow", 1, 10.0, 0.6, 5.0), (2, "outflow", 1, 10.0, 0.7, 5.0)], "mouth long, kind string, lake_id int, level double, depth double, half_width double")
    paths = spark.createDataFrame([(1, k, 9.0 + k, 20.0) for k in range(12)] + [(2, k, 31.0 - k, 20.0) for k in range(12)], "mouth long, ord int, x double, y double")
    return h, cells, made, paths


def test_mouths_open_the_shore_and_riffles_hold_the_lake(spark):
    h, cells, made, paths = scene(spark)
    bed, report = mouths.carve(cells, made, paths, h.shape, 5.0)
    out = np.zeros(h.shape)
    for r in bed.collect():
        out[r.row, r.col] = r.h
    said = {r.mouth: r for r in report.collect()}
    assert said[1].lowered > 0 and said[2].lowered > 0 and said[2].shut is None
    # The ring is cut in the throats and nowhere else; the river beside the outlet stands up as a riffle under the level.
    assert out[20, 10] < 10 and out[20, 30] < 10 and out[10, 15] == 10 and out[30, 25] == 10
    assert out[20, 31] == pytest.approx(10 - 0.8 + 0.2) and said[2].raised >= 1
    ring = np.zeros(h.shape, bool)
    ring[10, 10:31] = ring[30, 10:31] = ring[10:31, 10] = ring[10:31, 30] = True
    assert (out <= h + 1e-9)[~(h == h[20, 31])].sum() > 0 and (out[ring] <= 10).all()


def test_low_banks_keep_an_outlet_shut(spark):
    h, cells, made, paths = scene(spark, outlet_bank=9.0)
    bed, report = mouths.carve(cells, made, paths, h.shape, 5.0)
    said = {r.mouth: r for r in report.collect()}
    assert said[2].shut == "low_banks" and said[2].raised == 0
    assert {(r.row, r.col): r.h for r in bed.where("row = 20 and col = 30").collect()}[20, 30] == 10.0


def test_leaks(spark):
    h, cells, made, paths = scene(spark)
    # A lower river to the map's edge behind the inlet would drain the lake.
    low = cells.withColumn("h", F.expr("case when row = 20 and col < 10 then 9.0 else h end"))
    cut = mouths.cut(low, made, paths, h.shape, 5.0)
    assert [(r.mouth, r.how) for r in mouths.leaking_inlets(cut, low, h.shape, 5.0).collect()] == [(1, "map_edge")]


def test_heights_that_connect():
    rng = np.random.default_rng(4)
    bed = rng.integers(0, 9, (7, 8)).astype(float)
    allowed = rng.random((7, 8)) < 0.85
    seeds = np.zeros((7, 8), bool)
    seeds[0, 0] = allowed[0, 0] = True
    got = mouths.connect_heights(bed, allowed, seeds)
    want = np.where(seeds, bed, np.inf)
    for _ in range(60):  # relaxation to a fixed point
        padded = np.pad(want, 1, constant_values=np.inf)
        low = np.min([padded[1 + a : 8 + a, 1 + b : 9 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)], 0)
        want = np.where(allowed, np.minimum(want, np.maximum(bed, low)), want)
    assert np.array_equal(got, np.where(allowed, want, np.inf))


def test_drained_counts_all():
    bed = np.array([[5.0, 4, 3], [6, 9, 2], [1, 8, 7]])
    counts = mouths.drained(bed, np.ones((3, 3), bool))
    assert counts.sum() == 9 and counts[2, 0] == 4 and counts[1, 2] == 5


def test_crests_of_hollows():
    bed = np.full((9, 12), 5.0)
    bed[2:7, 1:5], bed[2:7, 7:11] = 2.0, 3.0
    own, throat = np.ones((9, 12), bool), np.zeros((9, 12), bool)
    throat[4, 11] = True
    bed[4, 11] = 3.5
    rules = mouths.MouthRules(hollow_samples=5)
    assert mouths.crest_of(bed, own, throat, rules) == pytest.approx(5.1)
    assert mouths.crest_of(np.full((9, 12), 5.0), own, throat, rules) == -np.inf


def test_low_ground_joins_its_lake(spark):
    n = 60
    h, kind = np.full((n, n), 12.0), np.zeros((n, n), int)
    kind[20:40, 20:40], h[20:40, 20:40] = 2, 9.0
    h[25:30, 40:44] = 9.5  # enclosed beside the lake
    h[22:24, 10:20] = 9.5  # leads away farther than 40 m
    h[50:52, 50:52] = 9.5  # doesn't touch it
    rows = [(r, c, float(h[r, c]), int(kind[r, c]), int(kind[r, c] == 2)) for r in range(n) for c in range(n)]
    cells = spark.createDataFrame(rows, "row int, col int, h double, kind int, lake_id int")
    got = shores.low_ground(cells, spark.createDataFrame([(1, 10.0)], "lake_id int, level double"), n, n, 5.0, most_m=40.0)
    assert {(r.row, r.col) for r in got.collect()} == {(r, c) for r in range(25, 30) for c in range(40, 44)}
