import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import codecs, hydraulics
from tarn.operators import stencil
from tarn.plans import utm
from tarn.plans.lattice import GridPlan, chunk_spans, fetch_chunks, next_pow2, plan_grid, tiling, utm_epsg_for_lon
from tarn.sources import binary


def grid(spark, a, name="h"):
    rows = [(r, c, None if isinstance(v, float) and math.isnan(v) else float(v)) for r, row in enumerate(np.asarray(a).tolist()) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, f"row int, col int, {name} double")


def dense(df, name, sy, sx):
    out = np.full((sy, sx), np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
    return out


def clamped(n):
    return [[min(max(2 * p + d, 0), n - 1) for d in (-1, 0, 1)] for p in range((n - 1) // 2 + 1)]


@pytest.mark.parametrize("shape", [(1, 1), (1, 5), (5, 3), (9, 7)])
def test_decimate(spark, shape):
    rng = np.random.default_rng(sum(shape))
    a = np.where(rng.random(shape) < 0.3, np.nan, rng.integers(0, 100, shape).astype(float))

    def axis(m):
        out = np.full(((m.shape[0] - 1) // 2 + 1, m.shape[1]), np.nan)
        for p, kids in enumerate(clamped(m.shape[0])):
            w = np.array([1, 2, 1])[:, None] * np.isfinite(m[kids])
            with np.errstate(invalid="ignore"):
                out[p] = (w * np.nan_to_num(m[kids])).sum(0) / w.sum(0)
        return out

    want = axis(axis(a.T).T)
    got = dense(stencil.decimate(grid(spark, a), *shape), "h", *want.shape)
    assert np.allclose(got, want, equal_nan=True)


def test_pyramid_of_a_plane_is_the_plane(spark):
    a = np.add.outer(np.arange(17) * 2.0, np.arange(9) * 3.0)
    got = stencil.pyramid(grid(spark, a), 17, 9, 3)
    assert got.where("level = 2").count() == 5 * 3
    inner = got.where("level = 1 and row = 3 and col = 2").first()
    assert inner["h"] == a[6, 4]


@pytest.mark.parametrize("seed", range(3))
def test_water_and_surface_and_labels(spark, seed):
    rng = np.random.default_rng(seed)
    code = rng.choice([0, 1, 2, 17, 18, 19], (7, 9))
    cells = grid(spark, code, "code").withColumn("code", F.col("code").cast("int")).withColumn("label", (F.col("row") * 9 + F.col("col")).cast("long"))
    water, label = np.zeros((4, 5)), np.zeros((4, 5))
    for p, rows in enumerate(clamped(7)):
        for q, cols in enumerate(clamped(9)):
            kids = [(r, c) for r in rows for c in cols]
            seen = [code[k] for k in kids]
            own = [v for v in seen if v >= 16]
            water[p, q] = max(own, key=lambda v: (seen.count(v), -seen.index(v))) if own else 1 if 1 in seen else 2 if 2 in seen else 0
            label[p, q] = min((code[k], k[0] * 9 + k[1]) for k in kids)[1]
    assert (dense(stencil.downsample_water(cells, 7, 9), "code", 4, 5) == water).all()
    assert (dense(stencil.downsample_label(cells, 7, 9), "label", 4, 5) == label).all()
    low = dense(stencil.downsample_min(cells.where("code > 0").withColumn("surface", F.col("code")), 7, 9), "surface", 4, 5)
    assert np.nanmin(low) == code[code > 0].min()


def test_hillshade(spark):
    flat = dense(stencil.hillshade(grid(spark, np.full((3, 4), 5.0)), 3, 4, 10.0), "shade", 3, 4)
    assert np.allclose(flat, math.sin(math.radians(45)))
    for down, right, want in ((-10.0, 10.0, math.sqrt(1 / 6)), (10.0, 10.0, 0.0)):  # at right angles to the light, and along it
        slope = np.add.outer(np.arange(4) * down, np.arange(4) * right)
        assert np.allclose(dense(stencil.hillshade(grid(spark, slope), 4, 4, 10.0), "shade", 4, 4), want)


def test_bilinear(spark):
    a = np.array([[0.0, 10.0], [20.0, np.nan]])
    points = spark.createDataFrame([(1, 0.0, 0.5), (2, 0.5, 0.5), (3, 1.0, 1.0), (4, 9.0, -3.0)], "id int, at_row double, at_col double")
    got = {r["id"]: r["h"] for r in stencil.bilinear(points, grid(spark, a), 2, 2).collect()}
    assert got[1] == 5 and got[2] == pytest.approx(10) and got[3] is None and got[4] == 20


def test_codecs(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (-9.0,), (None,), (1.5 / 65535,), (2.5 / 65535,)], "v double")
    low, high = F.lit(0.0), F.lit(1.0)
    got = [tuple(r) for r in df.select(codecs.pack_height(F.col("v"), low, high), codecs.pack_surface(F.col("v"), low, high)).collect()]
    assert [g[0] for g in got] == [0, 65535, 32768, 0, None, 2, 2] and got[4][1] == codecs.NO_SURFACE
    back = df.select("v", codecs.unpack_surface(codecs.pack_surface(F.col("v"), low, high), low, high).alias("b")).where("v between 0 and 1").collect()
    assert all(abs(r.v - r.b) <= 0.5 / 65534 for r in back)


def test_hydraulics(spark):
    q = spark.createDataFrame([(0.0,), (1.0,), (1e6,)], "q double")
    got = q.select(hydraulics.width_from_discharge(F.col("q")), hydraulics.depth_from_discharge(F.col("q")), hydraulics.smoothstep(F.col("q"))).collect()
    assert [tuple(r) for r in got] == [(2.0, 0.5, 0.0), (8.0, 2.0, 1.0), (80.0, 5.0, 1.0)]


def test_plans():
    assert [next_pow2(n) for n in (1, 2, 3, 9)] == [1, 2, 4, 16]
    assert [utm_epsg_for_lon(x) for x in (11.9, 12, 30)] == [25832, 25833, 25835]
    plan = plan_grid(13.0, 64.0, 13.2, 64.1, 10.0)
    assert (plan.leaf_tiles_x, plan.leaf_tiles_y, plan.num_levels) == (8, 16, 4)
    assert plan.origin_x % 10 == 0 and plan.total_bytes(2) == sum(8 * 16 >> 2 * k for k in range(4)) * 129 * 129 * 2
    assert tiling(513, 1025, 128) == (4, 8, 3) and tiling(385, 513, 128) is None
    assert GridPlan(1, 1.0, 0.0, 0.0, 64, 2, 4, 2).tile_rows(0, 1, 0) == (192, 64, 65)


@pytest.mark.parametrize("n,most", [(1, 4), (9, 4), (10, 4), (257, 64), (4609, 4096), (0, 3)])
def test_spans(n, most):
    spans = chunk_spans(n, most)
    assert sum(s for _, s in spans) == n and all(s <= most * 1.125 + 1 for _, s in spans)
    assert all(a + s == b for (a, s), (b, _) in zip(spans, spans[1:], strict=False))
    if spans:
        assert max(s for _, s in spans) - min(s for _, s in spans) <= 1


def test_chunks_cover():
    plan = GridPlan(1, 1.0, 0.0, 0.0, 64, 3, 3, 1)
    seen = np.zeros((193, 193), int)
    for x, y, nx, ny in fetch_chunks(plan, 64):
        seen[y : y + ny, x : x + nx] += 1
    assert (seen == 1).all()


def test_utm_round_trip():
    rng = random.Random(1)
    for _ in range(200):
        epsg = rng.choice((25832, 25833, 25835))
        lon, lat = (epsg - 25800) * 6 - 183 + rng.uniform(-4, 4), rng.uniform(55, 72)
        x, y = utm.forward(lon, lat, epsg)
        back = utm.inverse(x, y, epsg)
        assert abs(back[0] - lon) < 1e-8 and abs(back[1] - lat) < 1e-8
    assert utm.forward(15.0, 0.0, 25833) == (500000.0, pytest.approx(0.0))
    # On the central meridian the northing is the scaled length of the meridian: 4984944.378 m at 45 degrees on this ellipsoid.
    assert utm.forward(15.0, 45.0, 25833)[1] == pytest.approx(0.9996 * 4984944.378, abs=0.01)


def test_atlas_round_trip(spark, tmp_path):
    plan = GridPlan(1, 1.0, 0.0, 0.0, 4, 2, 4, 2)
    rng = np.random.default_rng(0)
    levels = [rng.integers(0, 60000, (17, 9)), rng.integers(0, 60000, (9, 5))]
    rows = [(k, r, c, int(v)) for k, a in enumerate(levels) for r, row in enumerate(a) for c, v in enumerate(row)]
    made = binary.tiles(spark.createDataFrame(rows, "level int, row int, col int, value int"), plan, "<u2")
    path = str(tmp_path / "a.atlas")
    assert binary.write_atlas(made, plan, 2, path) == plan.total_bytes(2)
    for k, a in enumerate(levels):
        assert (binary.read_level(path, plan, k, "<u2") == a).all()
    assert not binary.check_atlas(path, plan, 2)
    with open(path, "r+b") as f:
        f.truncate(100)
    assert binary.check_atlas(path, plan, 2)
    with pytest.raises(ValueError):
        binary.read_level(path, plan, 1, "<u2")


@pytest.mark.parametrize("how,off", [("none", 0), ("lossless", 0), ("mm", 6e-4), ("cm", 5.1e-3)])
def test_height_codec(tmp_path, how, off):
    h = np.random.default_rng(1).uniform(-5, 900, (7, 5)).astype("f4")
    h[2, 3] = np.nan
    block = binary.write_heights(str(tmp_path / "h"), h, how)
    back = binary.read_heights(str(tmp_path / "h"), block, h.shape)
    assert np.isnan(back[2, 3]) and np.nanmax(np.abs(back - h)) <= off


def test_record_files(spark, tmp_path):
    path = str(tmp_path / "x")
    assert binary.NODE.itemsize == 52 and binary.CURVE.itemsize == 260 and binary.BRANCH.size == 28
    rows = [tuple(range(7)) + (1, 2, 0.5, 1.5, 0.0, 3, 4, 0.25)]
    binary.write_table(path, "hierarchy", (1,) * 8, binary.NODE, rows)
    head, got = binary.read_table(path, "hierarchy", binary.NODE)
    assert head == (1,) * 8 and got[0]["outflow_head_m"] == 0.25 and got[0]["subtree_cells"] == 6
    with pytest.raises(ValueError):
        binary.read_table(path, "hypsometry", binary.CURVE)
    binary.write_cells(path, spark.createDataFrame([(8,), (5,), (18,)], "cell long"))
    assert list(binary.read_cells(path)) == [5, 8, 18]
    runs = spark.createDataFrame([(5, 9, 1), (4, 2, 3), (4, 7, 1)], "lake_id int, first_cell long, length long")
    binary.write_lake_runs(path, runs)
    assert binary.read_lake_runs(path) == {4: [(2, 3), (7, 1)], 5: [(9, 1)]}
    binary.write_lake_samples(path, spark.createDataFrame([(9, 2, 3), (7, 2, 4)], "label long, lake_id int, n long"))
    assert binary.read_lake_samples(path).tolist() == [(7, 2, 4), (9, 2, 3)]
