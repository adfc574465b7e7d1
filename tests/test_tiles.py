"""Lattices of several tiles: what goes on over a tile's edge, with no join that the driver would have to broadcast."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import beds, flow, graph, shores, spatial, tiles

SY, SX = 2 * tiles.SIDE + 30, 9


@pytest.fixture
def unsent(spark):
    """A session in which every broadcast fails: a table that is small as a file may hold millions of rows."""
    name = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(name, "1")
    yield spark
    spark.conf.unset(name)


def _lattice(spark, kinds: int, seed: int = 5, hole: bool = True):
    code = np.random.default_rng(seed).integers(0, kinds, (SY, SX))
    if hole:
        code[250:256, 4] = -1  # no data
    cells = spark.createDataFrame([(r, c, int(code[r, c])) for r in range(SY) for c in range(SX) if code[r, c] >= 0], "row int, col int, code int")
    return code, cells


def _strict(code):
    want = {}
    for r in range(SY):
        for c in range(SX):
            best = (0, None)
            for d, (a, b) in enumerate(flow.STEPS, 1):
                if 0 <= r + a < SY and 0 <= c + b < SX and 0 <= code[r + a, c + b] < code[r, c]:
                    steep = int(code[r, c] - code[r + a, c + b]) ** 2 * (2 if d % 2 else 1)
                    best = (steep, d) if steep > best[0] else best
            if code[r, c] >= 0:
                want[r, c] = 0 if r in (0, SY - 1) or c in (0, SX - 1) else best[1]
    return want


def _flats(code):
    """Sets of equal codes by flooding, in order of their first cells."""
    seen, out = set(), []
    for r, c in np.ndindex(SY, SX):
        if code[r, c] < 0 or (r, c) in seen:
            continue
        seen.add((r, c))
        flat = [(r, c)]
        for y, x in flat:
            for a, b in flow.STEPS:
                at = y + a, x + b
                if 0 <= at[0] < SY and 0 <= at[1] < SX and at not in seen and code[at] == code[r, c]:
                    seen.add(at)
                    flat.append(at)
        out.append(flat)
    return out


def _queued(code):
    """Flow with flats, a queue for each: outlets in raster order, then what they reach, by direction."""
    got = _strict(code)
    for flat in _flats(code):
        queue = sorted(x for x in flat if got[x] is not None)
        if not queue:
            got[flat[0]], queue = 0, [flat[0]]
        inside = set(flat)
        for y, x in queue:
            for d, (a, b) in enumerate(flow.STEPS, 1):
                at = y + a, x + b
                if at in inside and got[at] is None:
                    got[at] = (d + 3) % 8 + 1
                    queue.append(at)
    return got


def test_strict_directions_over_tiles(unsent):
    code, cells = _lattice(unsent, 16)
    assert {(r.row, r.col): r.flow for r in flow.strict_directions(cells, SY, SX).collect()} == _strict(code)


@pytest.mark.parametrize("kinds", [16, 2])
def test_flats_over_tiles(unsent, kinds):
    code, cells = _lattice(unsent, kinds)
    assert {(r.row, r.col): r.flow for r in flow.directions(cells, SY, SX).collect()} == _queued(code)


def test_catchments_over_tiles(unsent):
    code, cells = _lattice(unsent, 4)
    got, want = _queued(code), {}
    for at in got:
        while got[at]:
            at = at[0] + flow.STEPS[got[at] - 1][0], at[1] + flow.STEPS[got[at] - 1][1]
        want[at[0] * SX + at[1]] = want.get(at[0] * SX + at[1], 0) + 1
    assert {r.outlet: r.cells for r in flow.catchments(flow.directions(cells, SY, SX), SX).collect()} == want


@pytest.mark.parametrize("kinds", [16, 3])
def test_pits_over_tiles(unsent, kinds):
    code, cells = _lattice(unsent, kinds)
    want = []
    for flat in _flats(code):
        around = [(y + a, x + b) for y, x in flat for a, b in flow.STEPS]
        if all(0 < y < SY - 1 and 0 < x < SX - 1 for y, x in flat) and not any(0 <= code[at] < code[flat[0]] for at in around):
            want.append((len(want) + 1, int(code[flat[0]]), len(flat), flat[0][0] * SX + flat[0][1]))
    assert sorted(map(tuple, flow.pits(cells, SY, SX).collect())) == want


def test_components_over_tiles(unsent):
    code, cells = _lattice(unsent, 2)
    want = {at: flat[0][0] * SX + flat[0][1] for flat in _flats(code) for at in flat}
    assert {(r.row, r.col): r.comp for r in spatial.grid_components(cells, SX, "code", diagonal=True).collect()} == want


def test_ramps_of_bodies_over_tiles(unsent):
    """A body over two tiles is scaled as one, by its deepest sample."""
    kind = np.zeros((SY, SX), int)
    kind[200:300, 2:7] = kind[400:520, 4] = 2
    kind[500:505, 3:6] = 2
    cells = unsent.createDataFrame([(r, c, int(kind[r, c])) for r in range(SY) for c in range(SX)], "row int, col int, kind int")
    got = {(r.row, r.col): r.depth for r in beds.lake_ramp(cells, SX, 1.0, depth_m=20.0, ramp_m=40.0, least_m=2.0).collect()}
    dry = np.argwhere(kind == 0)
    ramp = {(int(y), int(x)): 20 * min(max((np.sqrt(((dry - (y, x)) ** 2).sum(1).min()) - 1) / 40, 0), 1) for y, x in np.argwhere(kind == 2)}
    want = {}
    for body in ({at for at in ramp if at[0] < 300}, {at for at in ramp if at[0] >= 400}):
        peak = max(ramp[at] for at in body)
        want |= {at: ramp[at] * max(1, 2 / peak) if peak > 1e-6 else 2.0 for at in body}
    assert got.keys() == want.keys() and all(got[at] == pytest.approx(want[at]) for at in want)


def test_scan_around_lake_samples(unsent):
    rng = np.random.default_rng(2)
    lake, h = np.repeat(np.repeat(rng.integers(0, 3, (SY // 8 + 1, 2)), 8, 0)[:SY], 5, 1)[:, :SX], rng.integers(0, 4, (SY, SX)).astype(float)
    h[100:110, 3] = np.nan
    rules = shores.ShoreRules(plane_m=1.0, flat_m=2.0, inset=2, band_m=15.0)
    cells = unsent.createDataFrame([(r, c, None if np.isnan(h[r, c]) else float(h[r, c]), int(lake[r, c])) for r in range(SY) for c in range(SX)], "row int, col int, h double, lake_id int")
    got = {(r.row, r.col): (r.inner, r.calm, r.near, r.outer) for r in shores._scan(cells, 5.0, rules).collect()}
    around = lambda r, c, n: [(r + a, c + b) for a in range(-n, n + 1) for b in range(-n, n + 1) if 0 <= r + a < SY and 0 <= c + b < SX]
    flat = {(r, c) for r, c in np.ndindex(SY, SX) if not np.isnan(h[r, c]) and np.ptp([h[x] for x in around(r, c, 1) if not np.isnan(h[x])]) <= 2}
    want = {}
    for r, c in np.ndindex(SY, SX):
        if lake[r, c] and not np.isnan(h[r, c]):
            same = lambda n: sum(lake[x] == lake[r, c] and not np.isnan(h[x]) for x in around(r, c, n))  # noqa: B023, E731
            calm = any(x in flat and abs(h[x] - h[r, c]) <= 1 for x in around(r, c, 1))
            near = any(lake[x] != lake[r, c] and (x[0] - r) ** 2 + (x[1] - c) ** 2 <= 9 for x in around(r, c, 3))
            want[r, c] = (same(2) == 25, calm, near, same(1) < 9)
    assert got == want


def test_shores_send_no_lattice(spark):
    """Tables of lakes may be broadcast, the lattice may not, however well its files are packed."""
    cells = spark.range(2600 * 65).select((F.col("id") / 65).cast("int").alias("row"), (F.col("id") % 65).cast("int").alias("col"), (F.col("id") % 7).alias("h"), (F.floor(F.col("id") / 6500) % 3).cast("int").alias("lake_id"))
    levels = spark.createDataFrame([(1, 4.5), (2, 2.5)], "lake_id int, level double")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "6000000")
    try:
        got = shores.split_shores(cells, levels, 2601, 65, 5.0)
        assert got.select("row", "col").distinct().count() == got.count() == cells.where("lake_id > 0").count()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize("at_once", [0, 1 << 20])
def test_catchments_link_only_cells_along_edges(unsent, monkeypatch, at_once):
    """Ways over three tiles and ways without end: what is followed from tile to tile are cells along edges, not the lattice."""
    code, followed = np.add.outer(SY - np.arange(SY), np.array([0, 5, 0, 5, 0, 5, 0, 5, 0])), []
    way = _strict(code)
    way |= {(255, 4): 5, (256, 4): 1, (100, 4): 5, (101, 4): 1}
    monkeypatch.setattr(flow, "jump", lambda pointers, *a: followed.append(pointers.count()) or graph.jump(pointers, at_once))
    rows = unsent.createDataFrame([(r, c, d) for (r, c), d in way.items()], "row int, col int, flow int")
    want = {}
    for at in way:
        seen = 0
        while at and way[at]:
            at, seen = (at[0] + flow.STEPS[way[at] - 1][0], at[1] + flow.STEPS[way[at] - 1][1]), seen + 1
            at = at if seen <= SY else None
        end = at and at[0] * SX + at[1]
        want[end] = want.get(end, 0) + 1
    assert want[None] > 200 and {r.outlet: (r.cells, r.area) for r in flow.catchments(rows, SX, 2.0).collect()} == {k: (n, 2.0 * n) for k, n in want.items()}
    assert len(followed) == 1 and 0 < followed[0] < SY * SX / 3


def test_catchments_take_few_jobs(unsent):
    """The driver keeps something of each job: flats and ways over tiles' edges take no rounds of the lattice."""
    _, cells = _lattice(unsent, 4)
    unsent.sparkContext.setJobGroup("few", "few")
    try:
        flow.catchments(flow.directions(cells, SY, SX), SX).collect()
        assert len(unsent.sparkContext.statusTracker().getJobIdsForGroup("few")) <= 50
    finally:
        unsent.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("most", [1, 40])
def test_large_flats_take_rounds(unsent, monkeypatch, most):
    monkeypatch.setattr(flow, "WHOLE", most)
    monkeypatch.setattr(flow, "TASK", 100)
    code, cells = _lattice(unsent, 4)
    assert {(r.row, r.col): r.flow for r in flow.directions(cells, SY, SX).collect()} == _queued(code)


def test_graphs_at_once(unsent):
    rng = np.random.default_rng(1)
    edges = unsent.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(500, 900)], "a long, b long")
    assert sorted(map(tuple, graph.components(edges, 1000).collect())) == sorted(map(tuple, graph.components(edges).collect()))
    chain = [(i, i + 1 if i < 400 else None) for i in range(401)] + [(450, 451), (451, 452), (452, 450), (453, 450), (460, 460), (470, 999), (471, 470)]
    pointers = unsent.createDataFrame(chain, "node long, next long")
    got = dict(map(tuple, graph.jump(pointers, 1000).collect()))
    assert got == dict(map(tuple, graph.jump(pointers).collect())) and got[0] == 400 and got[453] is None and 471 not in got
    none = pointers.where("node < 0")
    assert graph.jump(none, 1000).count() == 0 and graph.components(none.toDF("a", "b"), 1000).count() == 0
