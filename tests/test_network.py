"""Lines, networks, trees, their products and the sources, on small fixtures."""

import gzip
import json
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.operators import downhill, geometry, spatial, trees, walks
from tarn.plans.lattice import GridPlan, bounds, outline, suggested_name
from tarn.sources import fetch, network, previews

PLAN = GridPlan(25833, 10.0, 500000.0, 7100000.0, 32, 2, 1, 1)


def test_profiles_never_rise_and_restart_at_ridges():
    level = np.concatenate([np.linspace(100, 90, 40), 100 + 8 * np.sin(np.linspace(0, np.pi, 14)), np.linspace(89, 80, 40)])
    step, open_ = np.full(len(level), 5.0), np.ones(len(level), bool)
    surface, barriers = downhill.shape_line(level, np.full(len(level), np.inf), step, open_, 3, np.inf)
    assert len(barriers) == 1 and level[barriers[0][1]] == level[40:54].max()
    first, crest = barriers[0]
    assert (np.diff(surface[crest:]) <= 1e-9).all() and (np.diff(surface[:first]) <= 1e-9).all() and (surface <= level + 1e-9).all()
    short = np.concatenate([np.linspace(100, 90, 40), np.full(3, 95.9), np.linspace(89, 80, 40)])
    made, none = downhill.shape_line(short, np.full(len(short), np.inf), np.full(len(short), 5.0), np.ones(len(short), bool), 3, np.inf)
    assert none == [] and (np.diff(made) <= 1e-9).all()
    assert downhill.shaped(np.array([5.0, 6, 4]), np.array([9.0, 9, 3]), 2, 4.5).max() <= 4.5


def test_tails_are_graded_within_their_depth():
    arc = np.arange(20) * 5.0
    surface = np.full(20, 50.0)
    made = downhill.graded(surface, arc, 0, 19, 40.0, 5.0, 2.0)
    assert (surface - made).max() <= 2.0 + 1e-9 and (np.diff(made) <= 1e-9).all() and made[0] == 50
    deep = downhill.graded(surface, arc, 0, 19, 49.0, 5.0, 5.0)
    assert deep[-1] == 49 and (deep <= np.minimum(50, 49 + 0.3 * np.maximum(arc[-1] - arc - 5, 0)) + 1e-9).all()
    raised, over = downhill.backwater(np.array([9.0, 5, 4, 4]), np.full(4, np.inf), 0, 3, 6.0)
    assert raised.tolist() == [9, 6, 6, 6] and not over
    assert downhill.backwater(np.array([5.0, 5]), np.array([np.inf, 4.0]), 0, 1, 6.0)[0].tolist() == [5, 5]


def test_falls_are_softened_and_flats_tilted():
    arc, open_, none = np.arange(10) * 10.0, np.ones(10, bool), np.full(10, -np.inf)
    surface = np.array([20.0, 20, 20, 20, 20, 15, 15, 15, 15, 15])
    made = downhill.softened(surface, surface, np.full(10, np.inf), none, arc, open_, 4.0, 10.0)
    assert made[4] < 20 and (surface - made).max() <= 4 + 1e-9 and (np.diff(made) <= 1e-9).all() and made[5:].tolist() == [15] * 5
    steep = np.array([50.0, 40, 30, 20, 10, 5, 4, 3, 2, 1])
    assert downhill.softened(steep, steep, np.full(10, np.inf), none, arc, open_, 4.0, 10.0).tolist() == steep.tolist()
    lean = downhill.tilted(surface, surface, np.full(10, np.inf), none, open_, 4.0)
    assert np.allclose(np.diff(lean[:5]), -0.011) and lean[5:].tolist() == [15] * 5


def test_side_channels_fall_evenly():
    assert downhill.tied(np.array([0.0, 5, 10, 20]), 10.0, 8.0, 2).tolist() == [10, 9, 8, 8]
    assert downhill.tied(np.array([0.0, 5]), 8.0, 9.0, 1).tolist() == [8, 8]


def network_lines(spark):
    """A trunk 3 that 1 and 2 flow into; 3 enters a lake at level 60."""
    at = np.arange(30)
    level = {1: 100 - at * 0.5 + (at % 7 == 3) * 2, 2: 120 - at * 1.0, 3: 84 - at * 0.8}
    vertices = [(s, int(k), float(s * 1000 + 5 * k), 0.0, float(z), None, None) for s, zs in level.items() for k, z in enumerate(zs)]
    made = spark.createDataFrame(vertices, "seg_id long, ord int, x double, y double, level double, ceiling double, trench double")
    segments = spark.createDataFrame([(1, 3), (2, 3), (3, None)], "seg_id long, downstream long")
    spans = spark.createDataFrame([(3, 20, 25, 60.0)], "seg_id long, a int, b int, level double")
    order = downhill.flow_order(segments).select("seg_id", "downstream", "rank").withColumn("half_width", F.lit(4.0)).withColumn("carve", F.lit(1.5))
    return downhill.lines_of(made, order, spans)


def test_networks_run_downhill(spark):
    rows = {r.seg_id: r for r in downhill.profiles(network_lines(spark), 5.0).collect()}
    for r in rows.values():
        assert (np.diff(r.surface) <= 1e-6).all() or r.seg_id == 3
        assert np.allclose(np.array(r.surface) - np.array(r.bed), 1.5)
    trunk = np.array(rows[3].surface)
    assert trunk[0] <= rows[1].surface[-1] + 1e-9 and trunk[0] <= rows[2].surface[-1] + 1.5 + 1e-9
    assert (trunk[26:] <= 60 + 1e-9).all()
    report = downhill.lowered_report(network_lines(spark), downhill.profiles(network_lines(spark), 5.0)).first()
    assert report.vertices == 90 and report.lowered > 0
    empty = downhill.profiles(network_lines(spark).limit(0), 5.0)
    assert empty.count() == 0


def test_order_of_cycles(spark):
    got = {r.seg_id: (r.rank, r.cyclic) for r in downhill.flow_order(spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 99), (5, 4)], "seg_id long, downstream long")).collect()}
    assert got[1] == (0, False) and got[5] == (0, False) and got[4] == (1, False) and got[2][1] and got[3][1] and got[2][0] == 2


def test_bed_of_a_river(spark):
    cells = spark.createDataFrame([(r, c, 100.0, 1 if c in (4, 5, 6) else 0, 8.0, 2.0, 100.0) for r in range(9) for c in range(11)], "row int, col int, h double, kind int, half_width double, depth double, level double")
    vertices = spark.createDataFrame([(r, 5, 95.0 - r, 90.0 - r) for r in range(9)] + [(4, 5, 99.0, 99.0)], "row int, col int, surface double, bed double")
    got = {(r.row, r.col): (r.level, r.target) for r in downhill.river_bed(cells, vertices, 5.0, 3).collect()}
    assert got[3, 5] == (92.0, 87.0) and got[3, 4] == (92.0, 87.0) and set(c for _, c in got) == {4, 5, 6}
    assert got[4, 5] == (91.0, 86.0)


def test_burning_goes_on_downstream_and_begins_anew_at_crests(spark):
    path = [(1, k, 0, k, float(b), m) for k, (b, m) in enumerate([(9, 0), (5, 0), (7, 0)])] + [(2, k, 1, k, float(b), m) for k, (b, m) in enumerate([(8, 0), (6, 1), (9, 2), (10, 0), (8, 0)])]
    made = spark.createDataFrame(path, "seg_id long, place int, row int, col int, bed double, mark int")
    got = {(r.row, r.col): r.bed for r in downhill.burned_paths(made, spark.createDataFrame([(1, 2), (2, None)], "seg_id long, downstream long")).collect()}
    assert got == {(0, 0): 9, (0, 1): 5, (0, 2): 5, (1, 0): 5, (1, 3): 9, (1, 4): 8}


def test_banks_are_the_lowest_dry_ground(spark):
    cells = spark.createDataFrame([(r, c, 10.0 + abs(c - 10) - (c > 10) * 0.5, 1 if abs(c - 10) <= 1 else 0) for r in range(21) for c in range(21)], "row int, col int, h double, kind int")
    line = spark.createDataFrame([(1, k, 10.0, float(k + 5), 5.0) for k in range(8)], "seg_id long, ord int, x double, y double, half_width double")
    got = [r.ceiling for r in downhill.bank_ceilings(line, cells, 21, 21, 5.0).orderBy("ord").collect()]
    assert np.allclose(got, 10 + 1.70711 - 0.5)


def test_walks_end_as_they_should(spark):
    code = np.add.outer(np.zeros(9, int), 20 - np.arange(9))
    cells = []
    for r in range(9):
        for c in range(9):
            flow = 0 if c == 8 or (r, c) == (2, 5) else 3
            cells.append((r * 9 + c, r, c, flow, c == 8, r != 6 or c < 4, (r, c) == (2, 5)))
    grid = spark.createDataFrame(cells, "cell long, row int, col int, flow int, stop boolean, corridor boolean, pit boolean")
    starts = spark.createDataFrame([(1, 9, 17, 99), (2, 18, 26, 99), (3, 54, 62, 99), (4, 36, 41, 99), (5, 27, 35, 2)], "seg_id long, cell long, end_cell long, most int")
    got = {r.seg_id: (r.status, r.cell) for r in walks.river_walks(starts, grid, 9).collect()}
    assert got[1][0] == got[4][0] == got[5][0] == walks.OK and got[2] == (walks.PIT, 23) and got[3] == (walks.LEFT_CORRIDOR, 58)
    found = walks.walk_findings(walks.river_walks(starts, grid, 9), spark.createDataFrame([(7, 1.0, 3.5), (8, 1.0, 1.1)], "node long, floor_m double, spill_m double"), spark.createDataFrame([(23, 7), (58, 0)], "cell long, label long"))
    assert sorted((r.seg_id, r.status, r.node, r.depth) for r in found.collect()) == [(2, 2, 7, 2.5), (3, 1, None, None)]
    assert code[0, 0] == 20


def test_escapes(spark):
    rows = [(1, 0, 0, False, True), (1, 1, 1, True, False), (2, 5, 5, True, False), (2, 5, 6, False, True), (3, 4, 4, True, False), (3, 4, 5, False, False), (3, 7, 7, False, True)]
    cells = spark.createDataFrame(rows, "id long, row int, col int, seed boolean, rim boolean")
    assert sorted((r.id, r.how) for r in spatial.escapes(cells, 20, 20).collect()) == [(1, "map_edge"), (2, "unbounded")]


def test_inner_curves_sum_their_children(spark):
    leaf = [float(min(j, 47)) for j in range(64)]
    nodes = spark.createDataFrame([(0, 0, None, 0, 0, 0), (0, 1, 3, 0, 47, 47), (0, 2, 3, 10, 47, 60), (0, 3, 0, 0, 90, 80)], "grid int, node int, parent int, floor_code int, spill_code int, top_code int")
    leaves = spark.createDataFrame([(0, 1, leaf), (0, 2, [2.0] * 64)], "grid int, node int, area array<double>")
    got = {}
    for r in trees.inner_curves(nodes, leaves).collect():
        got.setdefault(r.node, {})[r.j] = (r.code, r.area)
    assert set(got) == {1, 2, 3} and all(len(c) == 64 for c in got.values())
    code, area = got[3][0]
    assert (code, area) == (0, 0.0)
    code, area = got[3][10]
    assert area == pytest.approx(float(code) + (2.0 if code >= 10 else 0.0))
    assert got[3][63][1] == pytest.approx(49.0)


def test_cap_report(spark):
    before = spark.createDataFrame([(1, 3.0), (2, 5.0)], "node long, head double")
    after = spark.createDataFrame([(1, 1.0, True), (2, 5.0, False)], "node long, head double, capped boolean")
    assert tuple(trees.cap_report(before, after).first()) == (1, 2.0, 2.0)
    flags = spark.range(1).select(trees.flagged(F.lit(5), trees.HEAD_CAPPED, F.lit(True)).alias("f")).first().f
    assert flags == 133


def test_widths_across_a_band(spark):
    edges = spark.createDataFrame([(1, -500.0, 0.0, 500.0, 0.0), (1, 500.0, 0.0, 500.0, 40.0), (1, 500.0, 40.0, -500.0, 40.0), (1, -500.0, 40.0, -500.0, 0.0)], "area long, x0 double, y0 double, x1 double, y1 double")
    rays = spark.createDataFrame([(1, 0.0, 15.0, 0.0, 1.0), (2, 100.0, 20.0, 0.0, 1.0), (3, 0.0, 90.0, 0.0, 1.0), (4, 0.0, 20.0, 1.0, 0.0)], "ray long, x double, y double, ux double, uy double")
    got = {r.ray: (r.width, r.middle) for r in geometry.measured_widths(rays, edges).collect()}
    assert got[1] == (40.0, 5.0) and got[2] == (40.0, 0.0) and 3 not in got and 4 not in got


def test_visual_widths(spark):
    rows = [(1, k, 10.0 * k, 0.0, 8.0, 2 if k < 3 else None, 40.0 if 10 <= k < 20 else None, False) for k in range(30)]
    made = spark.createDataFrame(rows, "seg_id long, ord int, x double, y double, modelled double, class int, measured double, wet boolean")
    got = [(r.width, r.source) for r in geometry.visual_widths(made).orderBy("ord").collect()]
    assert got[0] == (3.0, 2) and got[15] == (40.0, 9) and got[29] == (8.0, 0)
    assert 8 < got[8][0] < 40 and got[21][0] > got[23][0] > 8


def test_points_along_lines(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 5.0), (2, 0, 3.0, 3.0)], "seg_id long, ord int, x double, y double")
    got = [(r.seg_id, r.k, r.x, r.y) for r in geometry.every(line, 4.0).orderBy("seg_id", "k").collect()]
    assert got == [(1, 0, 0, 0), (1, 1, 4, 0), (1, 2, 8, 0), (1, 3, 10, 2), (2, 0, 3, 3)]
    assert [(r.x, r.y) for r in geometry.even(line.where("seg_id = 1"), 6.0).orderBy("k").collect()] == [(0, 0), (5, 0), (10, 0), (10, 5)]
    grid = geometry.LocalGrid.over(0.5, 0.0, 10.0, 9.5, 2.0)
    i, j = grid.ij(F.lit(3.0), F.lit(9.0))
    assert spark.range(1).select(i, j, grid.inside(i, j)).first()[:] == (0, 1, True) and (grid.x0, grid.y1) == (0.0, 10.0)


def segments(spark):
    rows = [(2, 7, None, 3, None, 1.5, 4.0, None, "elv-å", None, "0" * 31 + "f"), (1, None, 5, 2, 2, 0.5, 3.0, 9, None, "002.A", "ab" * 16)]
    made = spark.createDataFrame(rows, "seg_id long, strekn_lnr long, vatn_lnr long, order int, downstream long, discharge double, width double, node_id long, elvid string, vassdragsnr string, geom_hash string")
    vertices = spark.createDataFrame([(s, k, 500000.0 + 10 * k + s, 7100000.0, 5.0 - k, 6.0 - k) for s in (1, 2) for k in range(3)], "seg_id long, ord int, x double, y double, z double, level double")
    spans = spark.createDataFrame([(1, 1, 2, 4)], "seg_id long, a int, b int, lake_id int")
    return network.nested(made, vertices, spans)


def test_river_products_round_trip(spark, tmp_path):
    made = segments(spark).withColumn("vertex_width", F.when(F.col("seg_id") == 1, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))
    lakes = spark.createDataFrame([(4, 320.0, "nve_hoyde"), (5, 300.0, "dtm_raised")], "lake_id int, authored_level_m double, level_source string")
    junctions = spark.createDataFrame([(1, 1, "inflow", 4, 7, 5, 500010.123, 7100000.0, 4.0)], "seg_id long, ord int, kind string, lake_id int, strekn_lnr long, vatn_lnr long, x double, y double, z double")
    said = network.export_network(made, lakes, junctions, PLAN, str(tmp_path), stride_m=10.0, geojson=True)
    head, rows = network.read_rivers(str(tmp_path / "rivers.bin"))
    assert said["rivers"]["segments"] == 2 and head["vertices"] == 6 and (tmp_path / "rivers.bin").stat().st_size == said["rivers"]["bytes"]
    assert [r["seg_id"] for r in rows] == [1, 2] and rows[0]["spans"] == [(1, 2, 4)] and rows[1]["upstream"] == [1] and rows[1]["elvid"] == "elv-?"
    assert rows[0]["downstream"] == 2 and rows[1]["downstream"] == -1 and rows[1]["node_id"] == 0xFFFFFFFF and rows[0]["geom_hash"] == "ab" * 16
    assert rows[0]["vertices"].tolist() == [[1, 0, 5, 6], [11, 0, 4, 5], [21, 0, 3, 4]]
    widths = network.read_widths(str(tmp_path / "river_widths.bin"))
    assert widths[1].tolist() == [1, 2, 3] and widths[2].tolist() == [4, 4, 4]
    doc = json.loads((tmp_path / "lakes.json").read_text())
    assert [r["lake_id"] for r in doc["lakes"]] == [4, 5] and set(doc["level_sources"]) == {"nve_hoyde", "dtm_interior_low", "dtm_raised"} and said["lakes"]["with_raised_level"] == 1
    assert json.loads((tmp_path / "junctions.json").read_text())["junctions"][0]["position"] == [500010.12, 7100000.0, 4.0]
    features = json.loads((tmp_path / "rivers.geojson").read_text())["features"]
    assert features[0]["properties"]["lake_spans"] == [[1, 2, 4]] and features[1]["properties"]["downstream_id"] is None and features[0]["geometry"]["coordinates"][1] == [500011.0, 7100000.0, 4.0]
    with open(tmp_path / "rivers.bin", "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        network.read_rivers(str(tmp_path / "rivers.bin"))


def test_branch_ends_meet(spark):
    vertices = spark.createDataFrame([(1, k, 10.0 * k, 0.0, 0.0, 10.0 - k) for k in range(5)] + [(2, 0, 0.0, 0.0, 0.0, 1.0)], "seg_id long, ord int, x double, y double, z double, level double")
    ends = spark.createDataFrame([(1, 11.0, 5.0, None)], "seg_id long, first_level double, last_level double, upto int")
    got = {(r.seg_id, r.ord): r.level for r in network.retied(vertices, ends).collect()}
    assert got[1, 0] == 11 and got[1, 4] == 5 and got[1, 2] == pytest.approx(8.0) and got[2, 0] == 1


def test_pictures(spark):
    heights = np.array([[0.0, 50, 100], [np.nan, 25, 75]])
    rgb = previews.terrain_rgb(heights, np.ones((2, 3)))
    assert np.allclose(rgb[1, 0], previews.NODATA) and rgb.shape == (2, 3, 3) and rgb.max() <= 1
    assert np.allclose(previews.ramp(np.array([0.0, 1.0]), previews.DEPTH)[1], previews.DEPTH[-1][1:])
    assert np.allclose(previews.water_class_rgb(np.array([[2, 1, 0]]), np.array([[0, 8, 0]]))[0, :2], [previews.LAKE, previews.RIVER])
    assert np.allclose(previews.delta_rgb(np.array([[0.0, 5.0]]), 5.0)[0, 1], previews.DELTA[-1][1:])
    assert np.allclose(previews.surface_rgb(np.array([[1.0, 3.0]]))[0, 0], previews.DEPTH[-1][1:])
    assert np.allclose(previews.depth_rgb(np.array([[0.0, np.nan]]), 1.0), 0.1)
    png = previews.thumbnail(np.add.outer(np.arange(20.0), np.arange(30.0)), np.full((20, 30), 0.5), (0, 0, 290, 190), rivers=[[[0, 0], [290, 190]]], lakes=[[[50, 50], [150, 50], [150, 120], [50, 120]]])
    at, size = png.index(b"IDAT"), struct.unpack(">II", png[16:24])
    raw = zlib.decompress(png[at + 4 : at + 4 + struct.unpack(">I", png[at - 4 : at])[0]])
    pixels = np.frombuffer(raw, np.uint8).reshape(20, 91)[:, 1:].reshape(20, 30, 3)
    assert size == (30, 20) and tuple(pixels[10, 10]) == tuple(int(c * 255 + 0.5) for c in previews.LAKE) and previews.stride_for((4097, 513), 640) == 6


def tiff(values: np.ndarray, deflate: bool) -> bytes:
    data = values.astype("<f4").tobytes()
    data = zlib.compress(data) if deflate else data
    tags = [(256, 4, values.shape[1]), (257, 4, values.shape[0]), (258, 3, 32), (259, 3, 8 if deflate else 1), (273, 4, 8), (277, 3, 1), (278, 4, values.shape[0]), (279, 4, len(data)), (339, 3, 3)]
    body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<I", v) for t, k, v in tags) + b"\0\0\0\0"
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + body


class Service:
    """Recorded answers by the end of an address, and what was asked."""

    def __init__(self, answers, fail=0):
        self.answers, self.asked, self.fail = answers, [], fail

    def __call__(self, method, address, params):
        self.asked.append((method, address, params))
        if len(self.asked) <= self.fail:
            raise OSError("busy")
        got = self.answers(method, address, params)
        return got if isinstance(got, tuple) else (json.dumps(got).encode(), "application/json")


@pytest.mark.parametrize("deflate", [False, True])
def test_heights_of_a_service(deflate):
    want = np.array([[1.0, 2, 3], [4, -5000, 9999]])
    service = Service(lambda m, a, p: (tiff(want, deflate), "image/tiff"), fail=1)
    got = fetch.fetch_heights(service, "http://x/", 25833, 100.0, 200.0, 3, 2, 10.0, pause=0)
    assert got[0].tolist() == [1, 2, 3] and np.isnan(got[1, 1:]).all() and len(service.asked) == 2
    assert service.asked[0][2]["bbox"] == "95.0,195.0,125.0,215.0" and service.asked[0][1] == "http://x/exportImage"
    with pytest.raises(RuntimeError):
        fetch.fetch_heights(Service(lambda m, a, p: {"error": 1}), "http://x", 25833, 0, 0, 3, 2, 10.0, tries=2, pause=0)


def by_places():
    """A fetcher whose heights follow from the place alone; made here so that it travels to workers by value."""

    def at(epsg, x, y, nx, ny, spacing):
        return ((y + np.arange(ny)[::-1, None] * spacing) * 3 + x + np.arange(nx) * spacing).astype(np.float32) % 1000

    return at


by_place = by_places()


def by_value(f):
    """The same function as one of no module, which is pickled whole."""
    import types

    out = types.FunctionType(f.__code__, {"np": np}, "at")
    out.__module__ = "__main__"
    return out


def test_any_chunks_give_one_lattice(spark, tmp_path):
    whole = by_place(25833, PLAN.origin_x, PLAN.origin_y, PLAN.samples_x, PLAN.samples_y, 10.0)

    def flaky(epsg, x, y, nx, ny, spacing):
        if nx > 20:
            raise OSError("too large")
        return by_place(epsg, x, y, nx, ny, spacing)

    assert np.array_equal(fetch.split_fetch(flaky, 25833, PLAN.origin_x, PLAN.origin_y, PLAN.samples_x, PLAN.samples_y, 10.0, least=8), whole)
    cache = fetch.cache_dir(str(tmp_path), PLAN, "http://x")
    for _ in range(2):
        got = fetch.read_heights(spark, PLAN, by_value(by_place), most=20, cache=cache)
        back = np.full(whole.shape, np.nan)
        for r in got.collect():
            back[r.row, r.col] = r.h
        assert np.array_equal(back, whole)
    assert cache != fetch.cache_dir(str(tmp_path), PLAN, "http://y")


def test_features_come_page_by_page(spark):
    every = [{"type": "Feature", "geometry": {"type": "Point"}, "properties": {"vatnlnr": k}} for k in range(5)]
    service = Service(lambda m, a, p: {"features": every[int(p["resultOffset"]) : int(p["resultOffset"]) + 2]})
    got = list(fetch.query_features(service, "http://x", 3, 25833, bbox=(0, 0, 9, 9), page=2, pause=0))
    assert got == every and len(service.asked) == 3 and service.asked[0][2]["geometry"] == "0,0,9,9"
    assert [len(b) for b in fetch.batches(list(range(90)))] == [40, 40, 10]
    layers = fetch.survey_layers(spark, Service(lambda m, a, p: {"features": every if a.endswith("/4/query") else every[:1]}), PLAN, "http://x", {"surveys": 4, "contours": 2, "points": 1, "shores": 3})
    assert {r["layer"]: r["count"] for r in layers.groupBy("layer").count().collect()} == {"surveys": 5, "contours": 1, "points": 1, "shores": 1}


def test_layers_describe_themselves():
    answers = {"http://x/1": {"name": "rivers", "geometryType": "line", "maxRecordCount": 2000, "fields": [{"name": "elveordenstrahler", "type": "esriFieldTypeInteger"}]}, "http://x/2": {"error": "gone"}}
    layers = [fetch.Layer("a", "http://x/", 1, (("order", ("strahler", "elveordenstrahler")), ("level", ("hoyde",))), ("order", "level")), fetch.Layer("b", "http://x", 2)]
    one, two = fetch.describe_services(Service(lambda m, a, p: answers[a]), layers)
    assert one["resolved"] == {"order": "elveordenstrahler", "level": None} and one["missing"] == ["level"] and one["fields"][0]["type"] == "Integer" and "gone" in two["error"]


def test_municipalities_and_downloads():
    service = Service(lambda m, a, p: {"kommunenummer": 1 + (float(p["ost"]) > 500300), "kommunenavn": "N"} if float(p["nord"]) < 7100200 else 1 / 0)
    assert fetch.municipalities(service, "http://x", PLAN, 200.0) == [("1", "N"), ("2", "N")]
    files = {"files": [{"status": "Waiting"}, {"status": "ReadyForDownload", "downloadUrl": "u"}]}
    assert fetch.order_download(Service(lambda m, a, p: files), "http://x", "d", "1", "N", 25833) == "u"
    with pytest.raises(RuntimeError):
        fetch.order_download(Service(lambda m, a, p: {}), "http://x", "d", "1", "N", 25833)


def test_lakes_for_calibration(spark, tmp_path):
    surveys = spark.createDataFrame([(1, 5.0, 0), (1, 6.0, 1), (2, 0.0, 2), (3, 4.0, 3)], "vatnlnr long, maksdyp_m double, pos long")
    lines = spark.createDataFrame([(1, 2.0), (3, -1.0)], "vatnlnr long, dybde_m double")
    assert [(r.vatnlnr, r.maksdyp_m) for r in fetch.candidate_lakes(surveys, lines, lines.limit(0)).collect()] == [(1, 5.0)]
    assert fetch.lake_window([np.array([[0, 0], [5000, 900]])], 10.0, 100.0, 400) == (-100.0, -100.0, 261, 56, 20.0)
    ring = [[0, 0], [50, 0], [50, 50], [0, 0]]
    service = Service(lambda m, a, p: {"features": [{"attributes": {"a": 1}, "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"hoyde": 7}}] if "= 1" in p["where"] else []})
    numbers = {"lakes": 5, "surveys": 4, "contours": 2, "points": 1}
    for _ in range(2):
        got = fetch.fetch_lake(service, "http://x", by_place, numbers, 1, str(tmp_path), epsg=25833)
        assert got["hoyde"] == 7 and got["heights"].shape == (126, 126)
        assert fetch.fetch_lake(service, "http://x", by_place, numbers, 9, str(tmp_path), epsg=25833) is None
    assert len([a for a in service.asked if a[1].endswith("/5/query")]) == 2


def test_plans_and_small_files(tmp_path):
    assert fetch.sample_transform(PLAN, 1) == (20.0, 0.0, 499990.0, 0.0, -20.0, 7100330.0)
    assert fetch.synthetic_heights(25833, 0, 0, 5, 4, 10.0).shape == (4, 5)
    path = str(tmp_path / "a.json.gz")
    assert fetch.read_gz_json(path) == [] and fetch.write_gz_json(path, {"a": [1]}) == (tmp_path / "a.json.gz").stat().st_size
    assert fetch.read_gz_json(path) == {"a": [1]} and gzip.open(path).read() == b'{"a":[1]}'
    ring = outline(PLAN)
    assert ring[0] == ring[-1] and len(ring) == 5 and bounds(PLAN)[0] < bounds(PLAN)[2]
    assert suggested_name(PLAN) == "N7100-E500" and suggested_name(PLAN, "Lierne") == "Lierne"
    assert fetch.with_tiles(PLAN, 16).leaf_tiles_x == 4
    with pytest.raises(ValueError):
        fetch.with_tiles(PLAN, 24)
    demo = fetch.demo_features(PLAN)
    assert len(demo["rivers"]) == 6 and demo["rivers"][0]["geometry"]["coordinates"][-1] == demo["rivers"][1]["geometry"]["coordinates"][0]


def test_first_of_each(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 0, "y"), ("b", 2, "z")], "id string, pos long, v string")
    assert sorted(r.v for r in fetch.first_of_each(rows).collect()) == ["y", "z"]


def test_audit_summary(spark):
    lakes = spark.createDataFrame([("ok", None), ("ok", None), ("level_above_spill", "land")], "status string, spill_through string")
    rivers = spark.createDataFrame([(2,)], "status int")
    totals = spark.createDataFrame([(3, 1)], "unexplained long, joins_lake long")
    got = walks.audit_summary(lakes, rivers, 9, totals)
    assert got["lakes_by_status"] == {"level_above_spill": 1, "ok": 2} and got["lakes_above_spill_by_spill_through"] == {"land": 1} and got["unexplained_depressions"] == 3


def test_widths_of_areas_and_rays_at_one_place(spark):
    """Areas of the same edges count as the first of them; pairs of what is the same aren't made."""
    box = [(-500.0, 0.0, 500.0, 0.0), (500.0, 0.0, 500.0, 40.0), (500.0, 40.0, -500.0, 40.0), (-500.0, 40.0, -500.0, 0.0)]
    sides = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(side, ("x0", "y0", "x1", "y1"), strict=True))) for side in box)))
    edges = spark.range(5000).select((F.col("id") + 3).alias("area"), sides.alias("e")).select("area", "e.*")
    rays = spark.range(4000).select(F.col("id").alias("ray"), F.lit(0.0).alias("x"), F.when(F.col("id") % 2 == 0, 15.0).otherwise(20.0).alias("y"), F.lit(0.0).alias("ux"), F.lit(1.0).alias("uy"))
    assert geometry._shapes(edges).select("area").distinct().collect() == [(3,)] and geometry._one_of_each(rays).count() == 2
    got = geometry.measured_widths(rays, edges)
    assert got.count() == 4000 and got.where("width != 40 or middle != if(ray % 2 = 0, 5, 0)").count() == 0


def _width(ray, areas, reach):
    """As ``measured_widths`` says, one ray at a time."""
    x, y, ux, uy = ray

    def met(ux, uy, sides):
        side = lambda px, py: ux * (py - y) - uy * (px - x)
        cut = [(a, side(a[0], a[1]), side(a[2], a[3])) for a in sides]
        at = lambda a, s: (a[0] + (a[2] - a[0]) * s - x) * ux + (a[1] + (a[3] - a[1]) * s - y) * uy
        t = {at(a, s0 / (s0 - s1)) for a, s0, s1 in cut if (s0 <= 0) != (s1 <= 0)}
        t = {v for v in t if abs(v) <= reach}
        return sum(v > 0 for v in t), max((v for v in t if v <= 0), default=-reach), min((v for v in t if v > 0), default=reach)

    def bank(a):
        dx, dy = a[2] - a[0], a[3] - a[1]
        t = max(0.0, min(1.0, ((x - a[0]) * dx + (y - a[1]) * dy) / max(dx * dx + dy * dy, 1e-12)))
        return (a[0] + dx * t - x) ** 2 + (a[1] + dy * t - y) ** 2

    found = []
    for area, sides in areas.items():
        (ahead, low, high), (_, back, front) = met(ux, uy, sides), met(uy, -ux, sides)
        if ahead % 2 and front - back >= 0.75 * (high - low):
            found.append((high - low, area, (low + high) / 2, max(4 * min(map(bank, sides)) ** 0.5, 1.0)))
    if found:
        wide, _, mid, cap = min(found)
        return min(wide, cap), mid if wide <= cap else None


@pytest.mark.parametrize("block, pairs", [(128, 1 << 20), (3, 100)])
def test_widths_against_all(spark, monkeypatch, block, pairs):
    """Areas over several squares, crowded ones in parts; each pair is looked at once, in few jobs."""
    monkeypatch.setattr(geometry, "BLOCK", block)
    monkeypatch.setattr(geometry, "PAIRS", pairs)
    rng = np.random.default_rng(4)
    areas = {}
    for area in range(60):
        corners = (rng.integers(-20, 20, 2) * 8 + rng.integers(-30, 31, (rng.integers(3, 6), 2))).astype(float).tolist()
        areas[area] = [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    areas[60] = [(-40.0, -40.0, 40.0, -40.0), (40.0, -40.0, 40.0, 40.0), (40.0, 40.0, -40.0, 40.0), (-40.0, 40.0, -40.0, -40.0)]
    spots = [(float(x), float(y), *u) for (x, y), u in zip(rng.integers(-180, 180, (300, 2)), [(0.6, 0.8), (0.0, 1.0), (1.0, 0.0)] * 100, strict=True)] + [(9999.0, 9999.0, 1.0, 0.0)] + [(0.0, 40.0 - k, 0.0, 1.0) for k in range(80)]
    edges = spark.createDataFrame([(a, *e) for a, sides in areas.items() for e in sides] + [(61, None, 0.0, 1.0, 1.0)], "area long, x0 double, y0 double, x1 double, y1 double")
    rays = spark.createDataFrame([(k, *s) for k, s in enumerate(spots)] + [(900, None, 1.0, 0.0, 1.0)], "ray long, x double, y double, ux double, uy double")
    want = {k: w for k, s in enumerate(spots) if (w := _width(s, areas, 100.0))}
    spark.sparkContext.setJobGroup(f"widths {block}", "widths")
    try:
        got = {r.ray: (r.width, r.middle) for r in geometry.measured_widths(rays, edges, geometry.WidthRules(half_width_m=100.0)).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"widths {block}"))
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert len(want) > 60 and got.keys() == want.keys()
    for k, (width, middle) in want.items():
        assert got[k] == (pytest.approx(width), middle if middle is None else pytest.approx(middle))
    assert jobs <= 16
    nothing = geometry.measured_widths(rays, edges.where("area < 0"))
    assert nothing.count() == 0 and geometry.measured_widths(rays.where("ray < 0"), edges).count() == 0


def test_widths_where_all_places_differ():
    """Of a crowd of areas that all differ, a ray looks only at the edges of those that its line may cross ahead of it."""
    rng = np.random.default_rng(5)
    middles = rng.uniform(-90, 90, (400, 2))
    areas = {a: [(*p, *q) for p, q in zip(c, c[1:] + c[:1], strict=True)] for a, c in enumerate((m + rng.uniform(-12, 12, (4, 2))).tolist() for m in middles)}
    # A ring that goes twice over one side, and one that a ray leaves and enters at a corner.
    areas[400] = areas[0] + areas[0][:1]
    areas[401] = [(-20.0, -20.0, 20.0, -20.0), (20.0, -20.0, 0.0, 5.0), (0.0, 5.0, 20.0, 30.0), (20.0, 30.0, -20.0, 30.0), (-20.0, 30.0, 0.0, 5.0), (0.0, 5.0, -20.0, -20.0)]
    spots = [(*m, *u) for m, u in zip(middles.tolist(), [(0.6, 0.8), (0.0, 1.0), (1.0, 0.0), (-0.8, 0.6)] * 100, strict=True)] + [(0.0, float(y), 0.0, 1.0) for y in range(-30, 35)]
    edges = pa.table(dict(zip(("area", "x0", "y0", "x1", "y1"), map(list, zip(*((a, *e) for a, sides in areas.items() for e in sides), strict=True)), strict=True)))
    rays = pa.table(dict(zip(geometry.PLACE, map(list, zip(*spots, strict=True)), strict=True)))
    tracemalloc.start()
    try:
        measured = geometry._measured(rays, edges, 60.0).to_pylist()
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    got = {tuple(r[c] for c in geometry.PLACE): (r["width"], r["middle"]) for r in measured}
    want = {s: w for s in spots if (w := _width(s, areas, 60.0))}
    assert len(want) > 100 and got.keys() == want.keys()
    for s, (width, middle) in want.items():
        assert got[s] == (pytest.approx(width), middle if middle is None else pytest.approx(middle))
    # Less than two numbers for each pair of a ray and an edge.
    assert most < 16 * rays.num_rows * edges.num_rows
