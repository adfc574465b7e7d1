"""The command line: fetch regions into datasets, turn datasets into exports, list and check them."""

from __future__ import annotations

import argparse
import json
import os
import time

from tarn import manifests
from tarn.functions import hydraulics
from tarn.plans.lattice import plan_grid
from tarn.sources import binary, catalog, datasets, exports, fetch


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate()


def _area(p: argparse.ArgumentParser) -> None:
    """What says which region, and where heights come from."""
    p.add_argument("--bbox", type=float, nargs=4, required=True, metavar=("LON_MIN", "LAT_MIN", "LON_MAX", "LAT_MAX"))
    p.add_argument("--spacing", type=float, default=10.0, help="metres between samples")
    p.add_argument("--tile-cells", type=int, default=128)
    p.add_argument("--epsg", type=int)
    p.add_argument("--server", default="", help="address of an image service of heights; without one the region is made up")
    p.add_argument("--services", help="JSON file that names feature layers: a list of label, server, number")
    p.add_argument("--max-px", type=int, default=fetch.CHUNK)


def _switches(p: argparse.ArgumentParser) -> None:
    """What a job may switch."""
    p.add_argument("--no-water", action="store_true")
    p.add_argument("--no-estimate-levels", action="store_true")
    p.add_argument("--no-carve-lakes", action="store_true")
    p.add_argument("--no-hierarchy", action="store_true")
    p.add_argument("--no-network", action="store_true")
    p.add_argument("--lake-bed", choices=("ramp", "terrain"), default="ramp")
    p.add_argument("--ocean-level", type=float, default=0.0)
    p.add_argument("--nodata-fill", type=float, default=0.0)
    p.add_argument("--height-min", type=float)
    p.add_argument("--height-max", type=float)
    p.add_argument("--river-width-scale", type=float, default=1.0)


def options_of(a: argparse.Namespace):
    """The switches as a job takes them."""
    from tarn.process import Options

    return Options(not a.no_estimate_levels, not a.no_carve_lakes, not a.no_hierarchy, a.ocean_level, a.nodata_fill, a.height_min, a.height_max, a.lake_bed, not a.no_network)


def _layers(path: str | None) -> list[fetch.Layer]:
    if not path:
        return []
    with open(path, encoding="utf-8") as f:
        return [fetch.Layer(r["label"], r["server"], int(r["number"]), tuple((k, tuple(v)) for k, v in r.get("wanted", {}).items()), tuple(r.get("critical", ())), r.get("note")) for r in json.load(f)]


def _fetched(a: argparse.Namespace, root: str, folder: str | None = None) -> str:
    spark = _spark()
    plan = plan_grid(*a.bbox, a.spacing, a.tile_cells, a.epsg)
    layers = _layers(a.services)
    raw = fetch.water_layers(spark, fetch.http, plan, layers) if layers else datasets.demo_layers(spark, plan)
    heights = fetch.live_heights(fetch.http, a.server) if a.server else fetch.synthetic_heights
    return datasets.run_fetch(spark, plan, root, heights, raw, name=getattr(a, "name", None), folder=folder, server=a.server, most=a.max_px, request={"bbox_lonlat": a.bbox}, demo=not a.server)


def _processed(a: argparse.Namespace, folder: str) -> dict:
    from pyspark.sql import functions as F

    from tarn import process

    spark = _spark()
    began = time.perf_counter()
    if os.path.exists(os.path.join(folder, "cells.parquet")):  # cells that were prepared elsewhere
        plan = datasets.GridPlan(**catalog.read_manifest(folder, datasets.MANIFEST)["plan"])
        cells, lakes, raw = spark.read.parquet(f"{folder}/cells.parquet"), spark.read.parquet(f"{folder}/lakes.parquet"), None
    else:
        raw = spark.read.parquet(f"{folder}/features.parquet")
        plan, cells, lakes = datasets.prepared(spark, folder, tuple(w * a.river_width_scale for w in hydraulics.WIDTH_BY_ORDER))
    if getattr(a, "new_tile_cells", None):
        plan = fetch.with_tiles(plan, a.new_tile_cells)
    if a.no_water:
        cells, raw = cells.withColumn("kind", F.lit(0)).withColumn("lake_id", F.lit(0)), None
    made = process.process(spark, plan, cells, lakes, a.out, options_of(a), raw)
    catalog.append_run(spark, run_log(folder), manifests.run_record(made, out=a.out, seconds=time.perf_counter() - began, water=not a.no_water))
    report(a.out, made)
    return made


def run_log(folder: str) -> str:
    """Where a dataset's runs are logged."""
    return os.path.join(folder, "runs")


def report(out: str, manifest: dict) -> None:
    """What a job made, in a few lines."""
    for name, size in exports.Export.load(out).files()[:8]:
        print(f"  {size:>14,}  {name}")
    print(f"  heights {manifest['height_min']:.2f} to {manifest['height_max']:.2f} m; levels {json.dumps(manifest.get('level_sources', {}))}")
    print(json.dumps(manifest.get("statistics", {})))


def cmd_fetch(a) -> int:
    print(_fetched(a, a.root, a.dest))
    return 0


def cmd_replace(a) -> int:
    """Add survey or land-cover layers to a dataset."""
    spark, folder = _spark(), datasets.resolve(a.dataset, a.root)
    _, plan = datasets.load(folder)
    raw = fetch.water_layers(spark, fetch.http, plan, _layers(a.services))
    made = datasets.replace_layers(spark, folder, raw, datasets.SURVEYS if a.command == "fetch-bathymetry" else (datasets.WIDTHS,))
    print(json.dumps(made["layers"]))
    return 0


def cmd_list(a) -> int:
    for folder, manifest in catalog.list_folders(a.root, a.manifest):
        print(f"{manifest.get('created_utc', '-')}  {folder}  {manifest.get('name', '')}".rstrip())
        if a.verbose:
            print(json.dumps(manifest, indent=2, sort_keys=True))
    return 0


def cmd_process(a) -> int:
    _processed(a, a.dataset if os.path.isdir(a.dataset) else datasets.resolve(a.dataset, a.root))
    return 0


def cmd_build(a) -> int:
    _processed(a, _fetched(a, a.out, os.path.join(a.out, "dataset")))
    return 0


def _said(errors: list[str]) -> int:
    print("\n".join(errors) or "ok")
    return int(bool(errors))


def cmd_validate(a) -> int:
    """The files of an export; with ``--points`` also heights against a point service."""
    from tarn import process

    errors = process.validate(a.out)
    if a.points:
        export = exports.Export.load(a.out)

        def known(x: float, y: float) -> float | None:
            got = json.loads(fetch.http("GET", a.points, {"ost": x, "nord": y, "koordsys": export.plan.epsg})[0])
            return (got.get("punkter") or [{}])[0].get("z")

        found = exports.check_points(export, known, n=a.n)
        print(json.dumps({k: v for k, v in found.items() if k != "samples"}))
        errors += found["errors"]
    return _said(errors)


def cmd_validate_atlas(a) -> int:
    export = exports.Export.load(a.out)
    errors = []
    for kind, dtype in exports.ATLASES.items():
        if export.has(kind):
            plan = export.atlas_plan(kind)
            errors += [f"{kind}: {e}" for e in binary.check_atlas(export.path(kind), plan, binary.np.dtype(dtype).itemsize)]
            try:
                for level in range(plan.num_levels):
                    export.read_level(kind, level)
            except ValueError as error:
                errors.append(str(error))
    return _said(errors)


def cmd_validate_water(a) -> int:
    return _said(exports.check_water(a.out).get("errors", []))


def cmd_validate_hierarchy(a) -> int:
    """The tree recomputed from the packed heights, and compared with what was written."""
    from pyspark.sql import functions as F

    from tarn.operators import hierarchy

    spark, export = _spark(), exports.Export.load(a.out)
    head, nodes = binary.read_table(os.path.join(a.out, "hierarchy.bin"), "hierarchy", binary.NODE)
    codes = export.level_cells(spark, "heights", columns="code").withColumn("grid", F.lit(0)).withColumn("code", F.col("code").cast("int"))
    again = hierarchy.nodes(codes).orderBy("node").toPandas()
    errors = [] if len(again) == len(nodes) == head[2] else [f"{len(again)} nodes by the heights, {len(nodes)} in the file"]
    if not errors:
        for name, column in (("cell_count", "cells"), ("subtree_cells", "subtree_cells")):
            errors += [f"{name} differs"] if (again[column].to_numpy() != nodes[name]).any() else []
        for name in ("floor_code", "spill_code"):
            errors += [f"{name} differs"] if (again[name].fillna(0).to_numpy(int) != nodes[name]).any() else []
    return _said(errors)


def cmd_lake_indexes(a) -> int:
    print(json.dumps(exports.write_lake_indexes(_spark(), a.export)))
    return 0


def cmd_describe(a) -> int:
    for info in fetch.describe_services(fetch.http, _layers(a.services)):
        print(json.dumps(info if a.fields else {k: v for k, v in info.items() if k != "fields"}))
    return 0


def cmd_calibrate(a) -> int:
    """The sweep of a lake bed's settings over surveyed samples (Parquet: ``lake_id, q, depth, reach``)."""
    from tarn.operators import measures

    best = measures.calibration(_spark().read.parquet(a.samples)).orderBy("objective").limit(a.n)
    for row in best.toLocalIterator():
        print(json.dumps(row.asDict()))
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tarn", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def add(name: str, run, help_: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help_)
        p.set_defaults(run=run)
        return p

    p = add("fetch", cmd_fetch, "a region into a dataset")
    _area(p)
    p.add_argument("--name")
    p.add_argument("--root", default="datasets")
    p.add_argument("--dest")
    for name, what in (("fetch-bathymetry", "lake surveys"), ("fetch-n50", "river areas and width classes")):
        p = add(name, cmd_replace, f"add {what} to a dataset")
        p.add_argument("dataset")
        p.add_argument("--services", required=True)
        p.add_argument("--root", default="datasets")
    for name, manifest in (("datasets", datasets.MANIFEST), ("exports", exports.MANIFEST)):
        p = add(name, cmd_list, f"list the {name} of a folder, the newest first")
        p.add_argument("root")
        p.add_argument("--verbose", action="store_true")
        p.set_defaults(manifest=manifest)
    p = add("process", cmd_process, "a dataset to an export")
    p.add_argument("dataset")
    p.add_argument("out")
    p.add_argument("--root", default="datasets")
    p.add_argument("--tile-cells", type=int, dest="new_tile_cells")
    _switches(p)
    p = add("build", cmd_build, "fetch and process in one go")
    _area(p)
    p.add_argument("--out", required=True)
    _switches(p)
    p = add("validate", cmd_validate, "check an export's files, and perhaps heights against a point service")
    p.add_argument("out")
    p.add_argument("--points")
    p.add_argument("--n", type=int, default=12)
    for name, run, what in (("validate-atlas", cmd_validate_atlas, "sizes and tiles of the atlases"), ("validate-water", cmd_validate_water, "rivers, lakes and junctions"), ("validate-hierarchy", cmd_validate_hierarchy, "the tree, against the packed heights")):
        p = add(name, run, f"check {what}")
        p.add_argument("out")
    p = add("lake-indexes", cmd_lake_indexes, "make the lake indexes of an export anew")
    p.add_argument("export")
    p = add("describe-services", cmd_describe, "what layers hold, and how their fields resolve")
    p.add_argument("--services", required=True)
    p.add_argument("--fields", action="store_true")
    p = add("calibrate-lake-beds", cmd_calibrate, "sweep a lake bed's settings over surveyed samples")
    p.add_argument("samples")
    p.add_argument("--n", type=int, default=5)
    return out


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    raise SystemExit(main())
