from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import flow, graph, hierarchy, lakes, profiles, rivers, spatial


def cells_of(spark, **arrays):
    names = list(arrays)
    sy, sx = np.asarray(arrays[names[0]]).shape
    rows = [(r, c, *(int(arrays[n][r][c]) for n in names)) for r in range(sy) for c in range(sx)]
    return spark.createDataFrame(rows, "row int, col int, " + ", ".join(f"{n} int" for n in names))


def around(r, c, sy, sx):
    return [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and 0 <= r + a < sy and 0 <= c + b < sx]


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        if a != b:
            up.setdefault(a, {a}).update(up.setdefault(b, {b}))
            for x in up[a] | up[b]:
                up[x] = up[a] | up[b]
    changed = True
    while changed:
        changed = False
        for x in up:
            for y in list(up[x]):
                if up[y] != up[x]:
                    both = up[x] | up[y]
                    up[x] = up[y] = both
                    changed = True
    assert got == {x: min(s) for x, s in up.items()}


def test_jump_and_sums(spark):
    chain = [(i, i + 1 if i < 20 else None, 1) for i in range(21)] + [(50, 51, 2), (51, 50, 3), (52, 50, 4), (60, 60, 7)]
    nodes = spark.createDataFrame(chain, "node long, next long, value long")
    ends = {r.node: r.next for r in graph.jump(nodes).collect()}
    assert all(ends[i] == 20 for i in range(21)) and ends[50] is None and ends[60] == 60
    got = {r.node: r.total for r in graph.downstream_sums(nodes).collect()}
    assert [got[i] for i in range(21)] == list(range(1, 22))
    assert (got[50], got[51], got[52], got[60]) == (9, 9, 4, 7)


def test_confluence_discharge(spark):
    seg = spark.createDataFrame([(0, 2, "A", 10.0, 1), (1, 2, "A", 10.0, 1), (2, None, "B", 20.0, 5)], "seg_id long, downstream long, unit string, area_km2 double, length int")
    got = {r.seg_id: r for r in rivers.discharge(seg).collect()}
    assert [got[i].local_m2 for i in range(3)] == [5e6, 5e6, 20e6]
    assert got[2].total_m2 == 30e6 and got[2].discharge == pytest.approx(30e6 / 31557600)


@pytest.mark.parametrize("seed", range(3))
def test_directions_match_a_queue(spark, seed):
    rng = np.random.default_rng(seed)
    sy, sx = 9, 11
    code = rng.integers(0, 5, (sy, sx))
    want = np.full((sy, sx), -1)
    for r in range(sy):
        for c in range(sx):
            if r in (0, sy - 1) or c in (0, sx - 1):
                want[r, c] = 0
                continue
            best = 0
            for d, (a, b) in enumerate(flow.STEPS, 1):
                drop = code[r, c] - code[r + a, c + b]
                score = drop * drop * (2 if d % 2 else 1)
                if drop > 0 and score > best:
                    best, want[r, c] = score, d
    seen = np.zeros((sy, sx), bool)
    for r in range(sy):
        for c in range(sx):
            if seen[r, c]:
                continue
            group, todo = [], deque([(r, c)])
            seen[r, c] = True
            while todo:
                at = todo.popleft()
                group.append(at)
                for k in around(*at, sy, sx):
                    if not seen[k] and code[k] == code[r, c]:
                        seen[k] = True
                        todo.append(k)
            seeds = sorted(k for k in group if want[k] >= 0)
            if not seeds:
                want[min(group)] = 0
                seeds = [min(group)]
            todo = deque(seeds)
            while todo:
                a, b = todo.popleft()
                for d, (x, y) in enumerate(flow.STEPS):
                    k = (a + x, b + y)
                    if 0 <= k[0] < sy and 0 <= k[1] < sx and code[k] == code[r, c] and want[k] < 0:
                        want[k] = (d + 4) % 8 + 1
                        todo.append(k)
    got = {(r.row, r.col): r.flow for r in flow.directions(cells_of(spark, code=code), sy, sx).collect()}
    assert all(got[r, c] == want[r, c] for r in range(sy) for c in range(sx))


def test_catchments_and_slope(spark):
    code = 100 - np.add.outer(np.arange(5), np.arange(5))
    cells = cells_of(spark, code=code)
    way = flow.directions(cells, 5, 5)
    assert {r.flow for r in way.where("row between 1 and 3 and col between 1 and 3").collect()} == {4}
    got = flow.catchments(way, 5, 25.0)
    assert got.agg(F.sum("cells")).first()[0] == 25 and got.agg(F.sum("area")).first()[0] == 625


def bowls():
    one = np.full((9, 9), 10)
    one[2:7, 2:7] = 5
    one[4, :2] = 7
    two = np.full((9, 15), 20)
    two[2:7, 2:6], two[2:7, 8:13] = 4, 6
    two[4, 6:8], two[4, 13:] = 8, 9
    return one, two


def test_single_bowl(spark):
    one, _ = bowls()
    got = hierarchy.nodes(cells_of(spark, code=one).withColumn("grid", F.lit(0))).orderBy("node").collect()
    assert len(got) == 2
    leaf = got[1]
    assert (leaf.floor_code, leaf.spill_code, leaf.spill_cell, leaf.outlet_cell, leaf.parent, leaf.leaf) == (5, 7, 37, 36, 0, True)
    pits = flow.pits(cells_of(spark, code=one), 9, 9).collect()
    assert [(p.code, p.cells) for p in pits] == [(5, 25)]


def test_two_bowls(spark):
    _, two = bowls()
    got = hierarchy.nodes(cells_of(spark, code=two).withColumn("grid", F.lit(3))).orderBy("node").collect()
    assert [(r.parent, r.spill_code) for r in got] == [(None, None), (3, 8), (3, 8), (0, 9)]
    assert got[3].floor_code == 4 and sum(r.cells for r in got) == 135 and got[0].grid == 3
    assert got[3].subtree_cells == sum(r.cells for r in got[1:])


@pytest.mark.parametrize("seed", range(4))
def test_fill_levels_are_minimax(spark, seed):
    rng = np.random.default_rng(seed)
    sy, sx = int(rng.integers(6, 12)), int(rng.integers(6, 12))
    code = rng.integers(0, 8, (sy, sx))
    table, label = hierarchy.flood(code)
    fill = np.full((sy, sx), 10**6)
    fill[[0, -1], :] = code[[0, -1], :]
    fill[:, [0, -1]] = code[:, [0, -1]]
    for _ in range(sy * sx):
        for r in range(1, sy - 1):
            for c in range(1, sx - 1):
                fill[r, c] = min(fill[r, c], max(code[r, c], min(fill[k] for k in around(r, c, sy, sx))))
    for r in range(sy):
        for c in range(sx):
            n, level = int(label[r, c]), int(code[r, c])
            while n:
                level = max(level, int(table["spill_code"][n]))
                n = int(table["parent"][n])
            assert level == fill[r, c]
    assert table["cells"].sum() == code.size
    assert len(flow.pits(cells_of(spark, code=code), sy, sx).collect()) == int(table["leaf"].sum())


def test_axis_and_curve(spark):
    df = spark.createDataFrame([(2, 10, 20)], "f int, s int, t int")
    axis = df.select(hierarchy.axis(F.col("f"), F.col("s"), F.col("t"))).first()[0]
    assert axis == [(2 * (47 - i) + 10 * i + 23) // 47 for i in range(48)] + [(10 * (16 - k) + 20 * k + 8) // 16 for k in range(1, 17)]
    cells = spark.createDataFrame([(1, c) for c in (2, 2, 5, 20)], "label int, code int")
    leaves = spark.createDataFrame([(1, 2, 10)], "label int, floor_code int, spill_code int")
    got = hierarchy.leaf_curves(leaves, cells, 25.0).orderBy("j").collect()
    assert got[0].area == 50 and got[-1].area == 100 and got[47].area == 75


def test_unexplained_leaves_out_what_lakes_explain(spark):
    rows = [
        (0, None, None, 0.0, None, 999, False, None),
        (1, 5, 2, 0.0, 10.0, 300, True, 9.0), (2, 5, 1, 0.0, 10.0, 300, False, None), (5, 0, 0, 0.0, 20.0, 700, False, None),
        (3, 6, 4, 0.0, 10.0, 300, False, None), (4, 6, 3, 0.0, 10.0, 300, False, None), (6, 0, 5, 0.0, 30.0, 700, False, None),
        (7, 8, 6, 0.0, 10.0, 300, False, None), (8, 0, 6, 0.0, 12.0, 500, True, 11.0),
        (9, 0, 1, 0.0, 9.04, 400, False, None), (10, 0, 5, 0.0, 9.2, 400, False, None), (11, 0, 7, 0.0, 11.0, 400, False, None), (12, 0, 0, 0.0, 1.0, 900, False, None),
    ]
    tree = spark.createDataFrame(rows, "node long, parent long, overflow_to long, floor_m double, spill_m double, subtree_cells long, has_lake boolean, level double")
    top, totals = hierarchy.unexplained(tree, F.lit(25))
    # 2 spills at 10 over the lake's 9; 5 holds a lake, 7 lies in one, 9 and 11 join one, 3 and 4 lie in 6.
    assert [r.node for r in top.collect()] == [6, 10, 2]
    assert totals.first().asDict() == {"unexplained": 3, "joins_lake": 2}
    assert [r.node for r in hierarchy.unexplained(tree, F.lit(25), limit=1)[0].collect()] == [6]


def test_distance_nearest_ocean_and_touching(spark):
    rng = np.random.default_rng(5)
    mark = rng.random((7, 9)) < 0.15
    cells = cells_of(spark, source=mark).withColumn("source", F.col("source") == 1)
    got = {(r.row, r.col): r.d2 for r in spatial.distance(cells, 9).collect()}
    where = np.argwhere(mark)
    assert all(d == min((r - a) ** 2 + (c - b) ** 2 for a, b in where) for (r, c), d in got.items())
    near = spatial.nearest_within(cells.where("not source").select("row", "col"), cells.where("source").select("row", "col", F.lit(1).alias("k")), 3, "k")
    assert {(r.row, r.col): r.d2 for r in near.collect()} == {k: d for k, d in got.items() if 0 < d <= 9}
    h = np.full((5, 5), 9)
    h[0, 0], h[1, 0], h[1, 1], h[3, 3] = 0, 0, 0, 0
    low = cells_of(spark, h=h).withColumn("water", (F.col("row") == 1) & (F.col("col") == 1))
    assert {(r.row, r.col) for r in spatial.ocean_mask(low, 5, 5, 0).collect()} == {(0, 0), (1, 0)}
    lake = np.array([[1, 0, 2], [0, 2, 0], [3, 0, 0]])
    assert {(r.a, r.b) for r in lakes.touching_lakes(cells_of(spark, lake_id=lake)).collect()} == {(1, 2), (2, 3)}


def test_rasters(spark):
    square = spark.createDataFrame([(1, 1.5, 1.5, 1.5, 4.5), (1, 1.5, 4.5, 4.5, 4.5), (1, 4.5, 4.5, 4.5, 1.5), (1, 4.5, 1.5, 1.5, 1.5), (1, 2.5, 2.5, 2.5, 3.5), (1, 2.5, 3.5, 3.5, 3.5), (1, 3.5, 3.5, 3.5, 2.5), (1, 3.5, 2.5, 2.5, 2.5)], "id int, x0 double, y0 double, x1 double, y1 double")
    assert {(r.row, r.col) for r in spatial.raster_polygons(square, 9, 9).collect()} == {(r, c) for r in (2, 3, 4) for c in (2, 3, 4)} - {(3, 3)}
    pieces = spark.createDataFrame([(1, 0, 1, 1.0, 0.0, 2.0, 8.0, 2.0), (2, 0, 3, 3.0, 4.0, 0.0, 4.0, 8.0)], "id int, ord int, order int, width double, x0 double, y0 double, x1 double, y1 double")
    got = {(r.row, r.col): r.id for r in spatial.raster_lines(pieces, 9, 9).collect()}
    assert got[2, 0] == 1 and got[2, 4] == 2 and got[8, 5] == 2 and (4, 0) not in got


def test_lake_runs_example(spark):
    lake = np.array([[0, 1, 0, 0, 4], [5, 0, 1, 0, 0], [2, 2, 0, 3, 3]])
    got = {(r.lake_id, r.first_cell, r.length) for r in lakes.lake_runs(cells_of(spark, lake_id=lake), 5).collect()}
    assert got == {(1, 1, 1), (4, 4, 1), (5, 5, 1), (1, 7, 1), (2, 10, 2), (3, 13, 2)}


def test_level_cascade(spark):
    rows = [(1, 100.0, False), (2, 104.0, False), (3, 99.0, False), (4, 104.0, True), (5, None, False), (6, None, False), (7, 120.0, True), (8, None, False)]
    lake = spark.createDataFrame(rows, "lake_id int, published double, regulated boolean")
    rings = spark.createDataFrame([(i, 101.0, 102.0, 110.0) for i in range(1, 8)], "lake_id int, p10 double, p25 double, p90 double")
    inner = spark.createDataFrame([(1, 100.1), (2, 101.0), (3, 100.0), (4, 101.0), (5, 100.2), (6, 95.0)], "lake_id int, estimate double")
    pairs = spark.createDataFrame([(1, 5), (1, 6)], "a int, b int")
    got = {r.lake_id: (r.level, r.source) for r in lakes.level_cascade(lake, rings, inner, pairs).collect()}
    assert got == {1: (100.0, "nve_hoyde"), 2: (101.0, "dtm_corrected"), 3: (100.0, "dtm_raised"), 4: (104.0, "nve_hoyde"), 5: (100.0, "nve_neighbour"), 6: (95.0, "dtm_interior_low"), 7: (102.0, "dtm_corrected"), 8: (None, "none")}


def test_profiles(spark):
    level = [10.0, 12.0, 9.0, 11.0, 7.0, 8.0, 3.0]
    df = spark.createDataFrame([(1, i, v, 100.0) for i, v in enumerate(level)], "seg_id int, ord int, level double, ceiling double")
    run = np.minimum.accumulate(level)
    want, low = [], np.inf
    for i in range(7):
        w = min(2, i, 6 - i)
        low = min(low, run[i - w : i + w + 1].mean(), level[i])
        want.append(low)
    got = [r.shaped for r in profiles.shape_profile(df, 2).orderBy("ord").collect()]
    assert np.allclose(got, want)
    gaps = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, 6.0), (1, 4, None)], "seg_id int, ord int, v double")
    assert [r.v for r in profiles.fill_gaps(gaps, "v").orderBy("ord").collect()] == [2, 2, 4, 6, 6]
    assert [r.v for r in profiles.running(profiles.fill_gaps(gaps, "v"), "v", 3).orderBy("ord").collect()] == pytest.approx([2, 8 / 3, 4, 16 / 3, 6])


def test_barriers(spark):
    cap = [10, 10, 11, 20, 22, 18, 11, 10, 30, 9]
    rows = [(1, i, float(c), 10.0, 20.0, i == 8) for i, c in enumerate(cap)]
    df = spark.createDataFrame(rows, "seg_id int, ord int, cap double, shaped double, step double, wet boolean")
    got = [tuple(r) for r in profiles.barriers(df, flank_m=0.5).collect()]
    assert got == [(1, 2, 4)]


def test_rivers(spark):
    versions = spark.createDataFrame([("k", 1, 5, "a", 0), ("k", 2, 4, "b", 1), ("k", 2, 4, "c", 2), ("j", 0, 0, "d", 3)], "key string, date int, oid int, v string, pos int")
    assert {(r.key, r.v, r.pos) for r in rivers.dedupe_versions(versions, "key", "date", "oid").collect()} == {("k", "b", 0), ("j", "d", 3)}
    assert rivers.resolve_fields(["objectid", "Dato_For", "x_navn_y"], {"id": ("objectid",), "date": ("datofor",), "name": ("navn",), "no": ("zzz",)}) == {"id": "objectid", "date": "Dato_For", "name": "x_navn_y", "no": None}
    path = spark.createDataFrame([(1, i, lake) for i, lake in enumerate([0, 3, 3, 0, 3, 0, 0, 0, 4, 4, 0, 5, 5, 5])], "seg_id int, ord int, lake_id int")
    spans = rivers.lake_spans(path)
    assert {(r.a, r.b, r.lake_id) for r in spans.collect()} == {(1, 4, 3), (11, 13, 5)}
    ends = spark.createDataFrame([(1, 14)], "seg_id int, n int")
    assert {(r.lake_id, r.kind, r.ord) for r in rivers.junctions(spans, ends).collect()} == {(3, "inflow", 1), (3, "outflow", 4), (5, "inflow", 11)}
    up = spark.createDataFrame([(1, 0, 0.0, 0), (1, 1, 30.0, 0), (2, 0, 0.0, 0), (2, 1, 30.0, 7)], "seg_id int, ord int, z double, lake_id int")
    assert {(r.seg_id, r.ord, r.z) for r in rivers.orient(up).collect()} == {(1, 0, 30.0), (1, 1, 0.0), (2, 0, 0.0), (2, 1, 30.0)}
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 2, 3.0, 4.0)], "seg_id int, ord int, x double, y double")
    assert [(r.x, r.y) for r in rivers.densify(line, 2.5).orderBy("ord", "step").collect()] == [(0, 0), (1.5, 2), (3, 4)]


def test_measures(spark):
    from tarn.operators import measures

    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 10.0)], "seg_id int, ord int, x double, y double")
    n = {r.ord: (r.nx, r.ny) for r in measures.normals(line).collect()}
    assert n[0] == (0, 1) and n[1] == pytest.approx((-(0.5**0.5), 0.5**0.5))
    assert [r.curvature for r in measures.curvature(line).orderBy("ord").collect()] == pytest.approx([0, np.pi / 20, 0])
    back = line.withColumn("ord", 2 - F.col("ord"))
    assert measures.geometry_hash(line).first().hash != measures.geometry_hash(back).first().hash
    spans = spark.createDataFrame([(1, 1, 0, 5), (2, 1, 4, 9), (3, 1, 9, 12), (4, 2, 0, 1), (5, 1, 1, 2)], "id long, reach int, lo int, hi int")
    assert {r.id: r.group for r in measures.overlap_groups(spans).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}
    curve = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 10.0, 3.0), (1, 2, 10.0, 7.0), (1, 3, 20.0, 8.0)], "label int, j int, at double, value double")
    points = spark.createDataFrame([(1, 1, -5.0), (2, 1, 5.0), (3, 1, 10.0), (4, 1, 15.0), (5, 1, 99.0)], "id long, label int, z double")
    assert {r.id: r.value for r in measures.curve_values(points, curve).collect()} == {1: 1.0, 2: 2.0, 3: 7.0, 4: 7.5, 5: 8.0}
    q = [(lake, i / 10, 10 * 0.6 * (1 - np.exp(-0.9 * i / 10 / 0.6)), 10.0) for lake in (1, 2) for i in range(1, 10)]
    best = measures.calibration(spark.createDataFrame([(a, b, float(c), d) for a, b, c, d in q], "lake_id int, q double, depth double, reach double")).first()
    assert (best.k, best.b, best.scale) == (0.9, 0.6, 1.0) and best.objective < 1e-9


def test_ends_and_starts_at_one_place(spark):
    """Rows that start at one place are as many as they like; nothing is paired but places."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(1, 4)), *(int(v) for v in rng.integers(0, 4, 4))) for i in range(60)] + [(60, 9, 50, 50, 50, 50), (61, 9, 90, 90, 91, 90)]
    segments = spark.createDataFrame(rows, "seg_id long, order int, x0 int, y0 int, x1 int, y1 int")
    want = {}
    for a in rows:
        near = [(-b[1], b[0]) for b in rows if b[0] != a[0] and (b[2] - a[4]) ** 2 + (b[3] - a[5]) ** 2 <= 4]
        want[a[0]] = min(near)[1] if near else None
    assert {r.seg_id: r.downstream for r in rivers.link_ends(segments, 2.0).collect()} == want
    many = spark.range(40_000).select(F.col("id").alias("seg_id"), F.lit(1).alias("order"), *(F.lit(0).alias(c) for c in ("x0", "y0", "x1", "y1")))
    got = rivers.link_ends(many, 2.0)
    assert got.where("downstream = 0").count() == 39_999 and got.where("seg_id = 0").first().downstream == 1


def test_distance_windows_start_at_an_end(spark):
    """A window that ends at the far end of a column is summed anew for each of its rows."""
    cells = spark.range(60_000).select(F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), (F.col("id") % 50_000 == 7).alias("source"))
    got = spatial.distance(cells, 1)
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()
    assert got.where("d2 != least(abs(row - 7), abs(row - 50007)) * least(abs(row - 7), abs(row - 50007))").count() == 0 and got.count() == 60_000
