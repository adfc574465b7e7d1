import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn import queries
from tarn.operators import beds, paths, shores
from tarn.sources import catalog, features


def test_lake_ramp_and_carve(spark):
    kind = np.zeros((9, 9), int)
    kind[1:8, 1:8] = 2
    kind[0, 0] = 2
    rows = [(r, c, int(kind[r, c]), 50.0, int(kind[r, c] > 0)) for r in range(9) for c in range(9)]
    cells = spark.createDataFrame(rows, "row int, col int, kind int, h double, lake_id int")
    got = {(r.row, r.col): r.depth for r in beds.lake_ramp(cells, 9, 5.0, diagonal=False).collect()}
    assert got[1, 1] == 0 and got[4, 4] == 15 and got[2, 4] == 5 and got[0, 0] == 2
    levels = spark.createDataFrame([(1, 60.0)], "lake_id int, level double")
    h = {(r.row, r.col): r.h for r in beds.carve_lakes(cells, levels, 9, 5.0).collect()}
    assert h[4, 4] == 45 and h[0, 8] == 50


def test_carve_rivers_only_lowers(spark):
    rows = [(r, c, 1 if c in (3, 4, 5) else 0, 100.0) for r in range(5) for c in range(9)]
    cells = spark.createDataFrame(rows, "row int, col int, kind int, h double")
    channel = spark.createDataFrame([(r, 4, 100.0, 2.0, 6.0) for r in range(5)], "row int, col int, level double, depth double, half_width double")
    got = {(r.row, r.col): r.h for r in beds.carve_rivers(cells, channel, 2, 5.0).collect()}
    assert got[2, 4] == 98 and 98 < got[2, 3] <= 100 and got[2, 0] == 100


def test_river_trench_takes_all_river_samples(spark, monkeypatch):
    given = []
    carve = beds.carve_rivers
    monkeypatch.setattr(beds, "carve_rivers", lambda cells, centre, *a, **b: given.extend([cells, centre]) or carve(cells, centre, *a, **b))
    out = queries.river_trench(spark, "/root/testdata/sf0.001")
    assert given[1].count() == given[0].where("kind = 1").count() > 0
    assert out.count() > 0


def test_mouths(spark):
    v = spark.createDataFrame([(1, i, 9.0 if i < 3 else 5.0, 10.0 if 3 <= i <= 6 else None, 4.0, 1.5) for i in range(10)], "seg_id int, ord int, bed double, surface double, width double, order_depth double")
    spans = spark.createDataFrame([(1, 3, 6, 7)], "seg_id int, a int, b int, lake_id int")
    got = {r.kind: r for r in beds.mouths(v, spans).collect()}
    assert (got["inflow"].depth, got["inflow"].half_width, got["inflow"].level) == (1.0, 2.0, 10.0)
    assert got["outflow"].depth == 3.0 and got["outflow"].capped


def test_shares(spark):
    b = spark.createDataFrame([(1, 1, 3.0, 40.0), (2, 2, 3.0, 4.0), (3, 2, 4.0, 4.0)], "branch int, reach int, width double, stem_width double")
    got = {r.branch: r.share for r in beds.side_channel_shares(b).collect()}
    assert got[1] == pytest.approx(9 / 1609) and got[3] == pytest.approx(16 / 41)


def test_noise_is_fixed_to_the_ground(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x in range(0, 2000, 50) for y in range(0, 2000, 100)], "x double, y double")
    z = [r[0] for r in df.select(beds.noise(F.col("x"), F.col("y"), wavelength_m=400, octaves=5)).collect()]
    again = [r[0] for r in df.select(beds.noise(F.col("x") + 0.0, F.col("y"), wavelength_m=400, octaves=5)).collect()]
    assert z == again and -1 <= min(z) < -0.2 and 0.2 < max(z) <= 1


def test_shores(spark):
    n = 24
    lake = np.zeros((n, n), int)
    lake[4:20, 4:20] = 1
    h = np.where(lake == 1, 99.0, 110.0)
    h[4:7, 8:12] = 103.0 + np.add.outer(np.arange(3) * 0.7, np.arange(4) * 0.4)  # a spur from the shore
    h[15, 6] = 102.5  # a rock near the shore
    h[17, 15] = 100.4  # reeds
    h[10:12, 4] = 99.6  # wet ground
    rows = [(r, c, float(h[r, c]), int(lake[r, c])) for r in range(n) for c in range(n)]
    cells = spark.createDataFrame(rows, "row int, col int, h double, lake_id int")
    levels = spark.createDataFrame([(1, 100.0)], "lake_id int, level double")
    got = {(r.row, r.col): (r.part, r.anchor) for r in shores.split_shores(cells, levels, n, n, 5.0).collect()}
    assert len(got) == 256 and got[4, 9] == ("land", 99.0) and got[12, 12][0] == "plane"
    assert got[15, 6][0] == "island" and got[17, 15][0] == "plane" and got[10, 4][0] == "ground"


def test_cheapest_offsets_match_all_ways(spark):
    rng = np.random.default_rng(0)
    cost = rng.random((5, 4))
    cost[2, 1] = np.inf
    reach = np.array([0, 1, 2, 1, 1])
    best = min((sum(cost[i, k] for i, k in enumerate(w)) + 0.3 * sum(abs(a - b) for a, b in zip(w, w[1:], strict=False)), w) for w in np.ndindex(4, 4, 4, 4, 4) if all(abs(w[i] - w[i - 1]) <= reach[i] for i in range(1, 5)))
    got = paths.cheapest_offsets(cost, reach, 0.3, 1.0)
    assert tuple(got) == best[1]
    assert paths.cheapest_offsets(np.full((3, 3), np.inf), np.ones(3, int), 0.1, 1.0) is None
    cuts = spark.createDataFrame([(1, i, 5.0, [1.0, 1.0, 0.0]) for i in range(4)] + [(2, 0, 5.0, [None, None, None])], "seg_id long, ord int, along double, costs array<double>")
    assert {(r.seg_id, r.offset) for r in paths.snap_lines(cuts).collect()} == {(1, 1.0), (2, 0.0)}


def test_grade_tails(spark):
    rows = [(1, i, 20.0 - i, 5.0, 10.0, 3.0) for i in range(9)] + [(2, i, 5.0, 5.0, None, 3.0) for i in range(2)]
    df = spark.createDataFrame(rows, "seg_id long, ord int, surface double, along double, junction double, most double")
    got = {(r.seg_id, r.ord): r.surface for r in paths.grade_tails(df).collect()}
    line = [got[1, i] for i in range(9)]
    assert line[-1] == 10 and all(a >= b for a, b in zip(line, line[1:], strict=False)) and all(20 - i - line[i] <= 3 + 1e-9 for i in range(9))
    assert got[2, 0] == 5


def test_features(spark):
    import json

    raw = [json.dumps({"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}, "properties": {"objectid": 4, "strahler": "3.0", "elv": " 12 "}}), "not json", json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]], [[0.2, 0.2], [0.3, 0.2], [0.3, 0.3]]]}, "properties": {"arealkm2": "2", "hoyde": "0", "type": "Regulert"}})]
    got = features.parse_features(spark.createDataFrame(list(enumerate(raw)), "pos long, raw string"))
    assert {r.pos for r in got.collect()} == {0, 2}
    assert [(r.x, r.y) for r in features.line_vertices(got.where("kind = 'LineString'")).orderBy("ord").collect()] == [(0, 0), (3, 4)]
    assert features.polygon_rings(got.where("kind = 'Polygon'")).count() == 7
    river = features.river_attributes(got.where("pos = 0"), {"id": "objectid", "order": "strahler", "river_no": "elv", "date": None}).first()
    assert (river.feature_id, river.order, river.river_no, river.date) == (4, 3, "12", None)
    lake = features.lake_attributes(got.where("pos = 2"), {"id": None, "level": "hoyde", "area": "arealkm2", "kind": "type"}).first()
    assert (lake.published, lake.area_m2, lake.regulated) == (None, 2e6, True)
    line = spark.createDataFrame([(1, 1, 3.0, 4.0), (1, 0, 0.0, 0.0)], "seg_id int, ord int, x double, y double")
    assert json.loads(features.to_geojson(line).first().json)["geometry"]["coordinates"] == [[0.0, 0.0], [3.0, 4.0]]


def test_gml(spark):
    def member(name, kind, width, points):
        return f'<gml:featureMember><app:{kind} gml:id="{name}"><app:objtype>{kind}</app:objtype>{width}<gml:posList>{points}</gml:posList></app:{kind}></gml:featureMember>'

    text = '<gml:c xmlns:gml="g" xmlns:app="a">' + member("a", "ElvBekk", "<app:vannbredde>2</app:vannbredde>", "0 0 5 5") + member("b", "Elv", "", "1 1 2 2 3 1") + member("c", "Skog", "", "1 1 2 2") + member("d", "Elv", "", "90 90 99 99") + "</gml:c>"
    files = spark.createDataFrame([(text.encode(),)], "content binary")
    got = features.parse_land_cover(files, (0, 0, 10, 10)).collect()
    assert {(r.id, r.kind, r.width_class) for r in got} == {("a", "ElvBekk", 2), ("b", "Elv", None)}


def test_catalog(spark, tmp_path):
    assert catalog.slugify("Grønå 2/Æsen") == "grona-2-aesen" and catalog.slugify("??") == "dataset"
    root = str(tmp_path)
    for k, at in (("a", "2024"), ("b", "2025")):
        catalog.write_manifest(f"{root}/{k}", "dataset.json", {"format": "terrain-1", "created_utc": at})
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "dataset.json").write_text("{broken")
    assert [m["created_utc"] for _, m in catalog.list_folders(root, "dataset.json")] == ["2025", "2024"]
    assert catalog.unique_dir(root, "a").endswith("a-2")
    with pytest.raises(ValueError):
        catalog.read_manifest(f"{root}/a", "dataset.json", "other")
    log = f"file://{root}/runs"
    for k in range(3):
        catalog.append_run(spark, log, {"at": f"2025-0{k + 1}", "k": k})
    spark.createDataFrame([("garbage",)], "value string").write.mode("append").text(log)
    assert [r["at"] for r in catalog.read_runs(spark, log, 2).collect()] == ["2025-03", "2025-02"]


def test_small_and_touching_lakes_keep_their_planes(spark):
    flat = [(r, c, 10.0, 1 if 3 <= r <= 4 and 3 <= c <= 5 else 0) for r in range(9) for c in range(9)]
    cells = spark.createDataFrame([(r, c, 10.0 if k else 12.0, k) for r, c, _, k in flat], "row int, col int, h double, lake_id int")
    levels = spark.createDataFrame([(1, 10.5), (2, 10.5)], "lake_id int, level double")
    got = shores.split_shores(cells, levels, 9, 9, 5.0).collect()
    assert len(got) == 6 and {r.part for r in got} == {"plane"}
    # Two lakes side by side: what is within 15 m of the other lake is strip, though no land is near.
    rows = [(r, c, 9.0 if c in (9, 12) and r % 2 else 10.0, 1 if c < 10 else 2) for r in range(21) for c in range(21)]
    pair = spark.createDataFrame(rows, "row int, col int, h double, lake_id int")
    parts = {(r.row, r.col): r.part for r in shores.split_shores(pair, levels, 21, 21, 5.0).collect()}
    assert parts[9, 9] == "ground" and parts[9, 12] == "ground" and parts[9, 5] == "plane" and parts[10, 10] == "plane"
