"""From a made-up region to a dataset, an export and its checks, by the command line and by functions."""

import json
import os
from dataclasses import asdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn import cli, manifests, process
from tarn.functions import hydraulics
from tarn.operators import tracing
from tarn.plans.lattice import GridPlan
from tarn.sources import binary, catalog, datasets, exports, features, fetch, network

PLAN = GridPlan(25833, 10.0, 400000.0, 7100000.0, 32, 2, 2, 2)


@pytest.fixture(scope="module")
def region(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("datasets"))
    folder = datasets.run_fetch(spark, PLAN, root, fetch.synthetic_heights, datasets.demo_layers(spark, PLAN), name="Prøve", most=40, demo=True)
    return root, folder


def test_a_fetch_leaves_a_dataset(spark, region):
    root, folder = region
    manifest, plan = datasets.load(folder)
    assert plan == PLAN and os.path.basename(folder) == manifest["slug"] == "prove"
    assert manifest["layers"] == {"lakes": 1, "main_rivers": 1, "rivers": 6} and manifest["heights"]["nodata"] == 0 and manifest["heights"]["coverage_pct"] == 100
    assert manifest["bytes_total"] > 0 and not os.path.exists(os.path.join(root, ".chunks", "x")) and open(os.path.join(folder, "preview.png"), "rb").read(4) == b"\x89PNG"
    assert datasets.resolve("prove", root) == datasets.resolve("Prøve", root) == folder
    with pytest.raises(LookupError):
        datasets.resolve("elsewhere", root)
    raw = fetch.raw_features(spark, iter([{"properties": {"objtype": "Elv"}}, {"properties": {"objtype": "ElvBekk", "vannbredde": 2}}]), datasets.WIDTHS)
    assert datasets.replace_layers(spark, folder, raw, (datasets.WIDTHS,))["layers"] == {"Elv": 1, "ElvBekk_2": 1, "lakes": 1, "main_rivers": 1, "rivers": 6}
    assert datasets.replace_layers(spark, folder, raw.limit(0), (datasets.WIDTHS,))["layers"] == {"lakes": 1, "main_rivers": 1, "rivers": 6}


def test_features_become_cells(spark, region):
    plan, cells, lakes = datasets.prepared(spark, region[1], hydraulics.WIDTH_BY_ORDER)
    counts = {r.kind: r.n for r in cells.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    side = 0.2 * 640 / 10
    assert abs(counts[2] - side * side) < 30 and counts[1] > 60 and sum(counts.values()) == 65 * 65
    assert [tuple(r) for r in lakes.collect()] == [(1, 320.0, False)]
    best = datasets.river_cells(spark.read.parquet(f"{region[1]}/features.parquet"), PLAN, hydraulics.WIDTH_BY_ORDER)
    assert {r.order for r in best.select("order").distinct().collect()} >= {3, 6}


def test_a_network_is_traced(spark, region, tmp_path):
    raw = spark.read.parquet(f"{region[1]}/features.parquet")
    plan, cells, lakes = datasets.prepared(spark, region[1], hydraulics.WIDTH_BY_ORDER)
    orders = datasets.river_cells(raw, plan, hydraulics.WIDTH_BY_ORDER)
    lines = datasets.river_lines(raw)
    vertices = features.line_vertices(lines).select(F.col("pos").alias("line"), "ord", "x", "y")
    attributes = lines.select(F.col("pos").alias("line"), "order", F.col("river_no").alias("unit"), F.lit(3.0).alias("area_km2"), F.col("feature_id").alias("strekn_lnr"))
    traced = tracing.trace(vertices, attributes, cells.join(orders, ["row", "col"], "left"), plan)
    segments = {r.seg_id: r for r in traced.segments.collect()}
    assert len(segments) == 6 and segments[0].order == 6 and segments[0].downstream == 1 and segments[2].downstream == 1
    assert {r.lake_id for r in traced.spans.collect()} == {1}
    hydro = tracing.with_hydraulics(traced)
    levels = lakes.select("lake_id", F.col("published").alias("level"))
    profile = tracing.shaped(traced, hydro, cells, levels, plan)
    seg, made, joints = tracing.network(traced, hydro, cells, levels, plan, profile=profile, labels=cells.select("row", "col", F.lit(3).alias("label")))
    rows = {(r.seg_id, r.ord): r for r in made.collect()}
    span = traced.spans.first()
    assert rows[span.seg_id, span.a].level == 320.0 and {r.kind for r in joints.collect()} == {"inflow", "outflow"}
    # The made-up trunk climbs a hill, which is a ridge that the profile isn't cut through; it never stands above its own ground.
    trunk = [rows[0, k] for k in range(sum(s == 0 for s, _ in rows))]
    assert all(r.level <= r.z + 1e-6 for r in trunk)
    said = tracing.reports(traced, made)
    assert said["connectivity"]["segments"] == 6 and said["connectivity"]["dangling"] == 0
    whole = seg.withColumn("vatn_lnr", F.lit(None).cast("long")).withColumn("strekn_lnr", F.lit(None).cast("long")).withColumn("elvid", F.lit("e")).withColumn("vassdragsnr", F.lit("v"))
    whole = whole.select("seg_id", "strekn_lnr", "vatn_lnr", "order", "downstream", "discharge", "width", "node_id", "elvid", "vassdragsnr", "geom_hash")
    out = str(tmp_path)
    catalog.write_manifest(out, exports.MANIFEST, {"format": exports.FORMAT, "plan": asdict(plan), "height_min": 0.0, "height_max": 1.0, "network": {"rivers": {"segments": 6}}, "statistics": {"nodes": 4}})
    described = joints.withColumn("strekn_lnr", F.lit(1).cast("long")).withColumn("vatn_lnr", F.lit(1).cast("long"))
    network.export_network(network.nested(whole, made, traced.spans), spark.createDataFrame([(1, 320.0, "nve_hoyde")], "lake_id int, authored_level_m double, level_source string"), described, plan, out, stride_m=10.0)
    assert exports.check_water(out) == {"ok": True, "errors": [], "segments": 6, "lakes": 1} and exports.authored_lakes(f"{out}/lakes.json") == [1]
    with open(f"{out}/rivers.bin", "ab") as f:
        f.write(b"1")
    assert not exports.check_water(out)["ok"]


def test_the_command_line_goes_all_the_way(spark, region, tmp_path, capsys):
    root, folder = region
    out = str(tmp_path / "out")
    assert cli.main(["process", "prove", out, "--root", root, "--lake-bed", "terrain"]) == 0
    export = exports.Export.load(out)
    assert export.manifest["network"]["rivers"]["segments"] == 6 and export.manifest["network"]["junctions"]["count"] >= 2
    head, rivers = network.read_rivers(f"{out}/rivers.bin")
    assert head["vertices"] == export.manifest["network"]["rivers"]["vertices"] and {r["downstream"] for r in rivers} >= {-1, 1}
    assert exports.check_water(out)["errors"] == []
    assert {"heights", "surface", "water_id", "labels", "flowdir"} == {k for k in exports.ATLASES if export.has(k)}
    for command in ("validate", "validate-atlas", "validate-water", "validate-hierarchy"):
        assert cli.main([command, out]) == 0, command
    assert cli.main(["lake-indexes", out]) == 0 and binary.read_lake_runs(f"{out}/lake_cells.bin").keys() == {1}
    cells = export.level_cells(spark, "water_id")
    assert cells.count() == 65 * 65 and {(r.row, r.col): r.value for r in cells.collect()} == {(r, c): int(v) for (r, c), v in np.ndenumerate(export.read_level("water_id"))}
    kind, lake = export.read_water()
    assert (lake[kind == 1] == 1).all() and (kind == 1).sum() > 100 and np.isfinite(export.read_surface()[kind == 1]).all()
    at = np.argwhere(kind == 1)[50]
    assert export.class_at(PLAN.origin_x + at[1] * 10, PLAN.origin_y + (64 - at[0]) * 10) == "lake" and export.class_at(0, 0) == "outside"
    assert export.preview_level(40) == 1 and export.preview_level(10) == 1 and export.summary()["tiles_total"] == 5 and export.files()[0][1] >= export.files()[-1][1]
    labels = export.read_level("labels")
    nodes = binary.read_table(f"{out}/hierarchy.bin", "hierarchy", binary.NODE)[1]
    assert np.array_equal(np.bincount(labels.ravel(), minlength=len(nodes)), nodes["cell_count"])
    heights = export.read_heights()
    points = exports.check_points(export, lambda x, y: float(heights[64 - round((y - PLAN.origin_y) / 10), round((x - PLAN.origin_x) / 10)]), n=9)
    assert points["ok"] and len(points["samples"]) == 9 and points["max_abs_error_m"] < 1e-9
    assert not exports.check_points(export, lambda x, y: 1 / 0)["ok"]
    runs = catalog.read_runs(spark, cli.run_log(folder)).collect()
    logged = json.loads(runs[0].record)
    assert logged["out"] == out and logged["tiles"] == 5 and logged["set_hierarchy"] is True and logged["nodes"] == len(nodes)
    assert cli.main(["datasets", root, "--verbose"]) == 0 and "prove" in capsys.readouterr().out
    assert cli.main(["process", "prove", str(tmp_path / "flat"), "--root", root, "--tile-cells", "64", "--no-water", "--no-hierarchy"]) == 0
    assert exports.Export.load(str(tmp_path / "flat")).plan.leaf_tiles_x == 1


def test_blocks_of_a_manifest(spark):
    tree = spark.createDataFrame([(0, None, False, None, None, 100), (1, 3, True, 0, 10, 4), (2, 3, True, 5, 10, 60), (3, 0, False, 0, 20, 90)], "node int, parent int, leaf boolean, floor_code int, spill_code int, subtree_cells long")
    block = manifests.tree_block(tree, 0.1, cell_area=25.0)
    assert (block["node_count"], block["leaf_count"], block["minor"], block["draining_off_map"]) == (4, 2, 1, 1) and block["depth_m"]["max"] == 2.0
    ends = spark.createDataFrame([(1, 50.0), (2, 30.0)], "outlet long, area double")
    assert manifests.catchments_block(4, ends, 99)["area_m2"] == {"total": 80.0, "largest": 50.0}
    assert manifests.tiles_of({"bytes": 100, "tile_bytes": 20}) == 5 and manifests.tiles_of({}) is None
    assert manifests.tool_version("no-such-package") == "unpackaged" and manifests.curves_block(3, 9)["samples"] == 64
    assert manifests.water_block(2.0)["width_by_order_m"][0] == 4.0 and manifests.lake_bed_block("terrain", {}, {})["model"] == "terrain"
    assert process.label_levels and manifests.generator(PLAN, {})["crs"] == "EPSG:25833"


def test_an_audit_is_written(spark, tmp_path):
    one = spark.createDataFrame([(1, "ok")], "lake_id int, status string")
    said = exports.write_audit(str(tmp_path), {"lakes": 1}, one, one.limit(0), one)
    doc = json.loads((tmp_path / "water_audit.json").read_text())
    assert doc["lakes"] == [{"lake_id": 1, "status": "ok"}] and doc["rivers"] == [] and said["bytes"] > 0
