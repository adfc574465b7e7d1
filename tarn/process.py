"""From a dataset to an export: heights and water on a lattice become atlases, the depression tree, indexes and a manifest."""

from __future__ import annotations

import datetime
import os
import time
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn import manifests
from tarn.functions import codecs, hydraulics
from tarn.operators import audit, beds, flow, hierarchy, lakebeds, lakes, spatial, stencil, tracing
from tarn.plans.lattice import GridPlan
from tarn.runtime import ship, written
from tarn.sources import binary, catalog, datasets, features, network

FORMAT = "terrain-export-1"


@dataclass(frozen=True)
class Options:
    """What a run may switch."""

    estimate_levels: bool = True
    carve_lakes: bool = True
    hierarchy: bool = True
    ocean_level_m: float = 0.0
    nodata_fill_m: float = 0.0
    height_min: float | None = None
    height_max: float | None = None
    lake_bed: str = "ramp"
    network: bool = True


#: Parts of one mapped line, at most: lines are numbered by feature and part.
PARTS = 4096


def _carved(base: DataFrame, levels: DataFrame, plan: GridPlan, options: Options) -> DataFrame:
    """The lattice with its lake beds, by the model that is asked for: ``ramp``, or ``terrain``, which goes on with the land's slope."""
    if options.lake_bed == "terrain":
        made = lakebeds.lake_beds(base, levels, (plan.samples_y, plan.samples_x), plan.spacing_m, origin=(plan.origin_x, plan.origin_y))
        return base.join(made.select("row", "col", F.col("h").alias("bed")), ["row", "col"], "left").select("row", "col", F.coalesce("bed", F.col("h").cast("double")).alias("h"))
    return beds.carve_lakes(base, levels, plan.samples_x, plan.spacing_m)


def write_network(spark: SparkSession, raw: DataFrame, plan: GridPlan, base: DataFrame, bed: DataFrame, levels: DataFrame, labels: DataFrame | None, out: str) -> dict:
    """Trace the rivers of raw features, shape them downhill, and write their products; what the manifest says of them.

    Base: ``row, col, h, kind, lake_id`` as repaired; bed: ``row, col, h`` as carved.
    """
    lines = datasets.river_lines(raw)
    number = (F.col("pos") * PARTS).cast("long")
    each = features.line_vertices(lines)
    vertices = each.select((number + F.col("part")).alias("line"), "ord", "x", "y")
    parts = each.select("pos", "part").distinct().join(lines, "pos")
    attributes = parts.select((number + F.col("part")).alias("line"), "order", F.col("river_no").alias("unit"), F.lit(None).cast("double").alias("area_km2"), "feature_id")
    orders = written(datasets.river_cells(raw, plan, hydraulics.WIDTH_BY_ORDER), "orders")
    traced = tracing.trace(vertices, attributes.drop("feature_id"), base.join(orders, ["row", "col"], "left"), plan)
    hydro = written(tracing.with_hydraulics(traced), "hydraulics")
    profile = written(tracing.shaped(traced, hydro, base, levels, plan), "profiles")
    segments, shaped, joints = tracing.network(traced, hydro, bed, levels, plan, profile=profile, labels=labels)
    named = segments.join(attributes.select("line", "feature_id"), "line")
    none = F.lit(None)
    whole = named.select("seg_id", F.col("feature_id").alias("strekn_lnr"), none.cast("long").alias("vatn_lnr"), "order", "downstream", F.coalesce("discharge", F.lit(0.0)).alias("discharge"), "width", "node_id", none.cast("string").alias("elvid"), F.col("unit").alias("vassdragsnr"), "geom_hash")
    records = lakes.lake_records(base).join(levels.select("lake_id", F.col("level").alias("authored_level_m"), F.col("source").alias("level_source")), "lake_id", "left").withColumn("level_source", F.coalesce("level_source", F.lit("none")))
    junctions = joints.join(whole.select("seg_id", "strekn_lnr", "vatn_lnr"), "seg_id")
    made = network.export_network(network.nested(whole, shaped, traced.spans), records, junctions, plan, out, stride_m=plan.spacing_m)
    return made | {"validation": tracing.reports(traced, shaped)}


def process(spark: SparkSession, plan: GridPlan, cells: DataFrame, lake_table: DataFrame, out: str, options: Options = Options(), raw: DataFrame | None = None) -> dict:
    """Write an export to the folder ``out`` and return its manifest.

    Cells: ``row, col, h`` (null: none)``, kind, lake_id``; lakes: ``lake_id, published, regulated``; raw: unparsed
    features of a dataset, whose rivers become a network. A stage's table is written before it is read twice.
    """
    ship(spark)
    os.makedirs(out, exist_ok=True)
    sx, sy, seconds = plan.samples_x, plan.samples_y, {}
    began = time.perf_counter()

    def done(stage: str) -> None:
        nonlocal began
        seconds[stage] = round(time.perf_counter() - began, 3)
        began = time.perf_counter()

    filled = lakes.fill_voids(cells, sx).withColumnRenamed("h", "repaired")
    base = written(cells.join(filled, ["row", "col"]).select("row", "col", F.col("repaired").alias("h"), "kind", "lake_id"), "repaired")
    done("voids")
    rings = lakes.ring_percentiles(base, {"p10": 0.1, "p25": 0.25, "p90": 0.9})
    interior = lakes.interior_levels(base)
    if not options.estimate_levels:
        interior = interior.limit(0)
    levels = written(lakes.level_cascade(lake_table, rings, interior, lakes.touching_lakes(base)), "levels")
    done("levels")
    carved = _carved(base, levels, plan, options) if options.carve_lakes else base.select("row", "col", F.col("h").cast("double").alias("h"))
    bed = written(carved.join(base.select("row", "col", "kind", "lake_id"), ["row", "col"]).select("row", "col", F.coalesce("h", F.lit(options.nodata_fill_m)).alias("h"), "kind", "lake_id"), "bed")
    done("beds")
    low, high = bed.agg(F.min("h"), F.max("h")).first()
    low = options.height_min if options.height_min is not None else (low if low is not None else 0.0)
    high = options.height_max if options.height_max is not None else (high if high is not None else 1.0)
    high = high if high > low else low + 1
    bounds = F.lit(float(low)), F.lit(float(high))
    heights = stencil.pyramid(bed, sy, sx, plan.num_levels).select("level", "row", "col", codecs.pack_height(F.col("h"), *bounds).alias("value"))
    binary.write_atlas(binary.tiles(heights, plan, "<u2"), plan, 2, f"{out}/heights.atlas")
    done("heights")
    surface = base.join(levels, "lake_id").where("lake_id > 0 and level is not null").select("row", "col", F.col("level").alias("surface"))
    sea = spatial.ocean_mask(base.withColumn("water", F.col("kind") != 0), sy, sx, options.ocean_level_m).withColumn("sea", F.lit(True))
    code = base.join(sea, ["row", "col"], "left").select("row", "col", codecs.water_code(F.col("kind"), F.col("lake_id"), F.coalesce("sea", F.lit(False))).alias("code"))
    # Each level is written once, so that a coarser one doesn't make all finer ones anew.
    codes, tops, ny, nx = [written(code, "water-id")], [written(surface, "surface")], sy, sx
    for _ in range(1, plan.num_levels):
        codes.append(written(stencil.downsample_water(codes[-1], ny, nx), "water-id"))
        tops.append(written(stencil.downsample_min(tops[-1], ny, nx), "surface"))
        ny, nx = stencil.half(ny), stencil.half(nx)
    leveled = lambda parts, value: _stacked([p.select(F.lit(k).alias("level"), "row", "col", value.alias("value")) for k, p in enumerate(parts)])
    binary.write_atlas(binary.tiles(leveled(codes, F.col("code")), plan, "<u2"), plan, 2, f"{out}/water_id.atlas")
    binary.write_atlas(binary.tiles(leveled(tops, codecs.pack_surface(F.col("surface"), *bounds)), plan, "<u2", codecs.NO_SURFACE), plan, 2, f"{out}/surface.atlas")
    binary.write_lake_runs(f"{out}/lake_cells.bin", lakes.lake_runs(base, sx))
    done("water")
    stats: dict = {}
    blocks: dict = {}
    named = None
    if options.hierarchy:
        packed = bed.select(F.lit(0).alias("grid"), "row", "col", codecs.pack_height(F.col("h"), *bounds).alias("code"))
        tree = written(hierarchy.nodes(packed), "nodes")
        write_nodes(tree, f"{out}/hierarchy.bin", low, high)
        way = written(flow.directions(packed, sy, sx), "flow")
        ends = flow.catchments(way, sx, plan.spacing_m**2)
        named = written(hierarchy.labels(packed), "labels")
        write_labels(named, plan, sy, sx, f"{out}/labels.atlas")
        write_flow(way, plan, f"{out}/flowdir.atlas")
        counts = lakes.lake_label_counts(base.where("lake_id > 0").join(named.where("label > 0").select("row", "col", "label"), ["row", "col"]), levels.where("level > 0").select("lake_id"))
        binary.write_lake_samples(f"{out}/lake_samples.bin", counts)
        step = (high - low) / 65535
        blocks = {"hierarchy": manifests.tree_block(tree, step, cell_area=plan.spacing_m**2)}
        stats = {"nodes": tree.count(), "leaves": tree.where("leaf").count(), "outlets": ends.count(), "tree_errors": audit.check_tree(tree).count()}
        done("hierarchy")
    if raw is not None and options.network and not raw.where(F.col("layer") == datasets.RIVERS).isEmpty():
        blocks["network"] = write_network(spark, raw, plan, base, bed, levels, named, out)
        done("network")
    manifest = {"format": FORMAT, "plan": asdict(plan), "options": asdict(options), "height_min": low, "height_max": high, "created_utc": datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "seconds": seconds, "statistics": stats, **blocks}
    manifest["atlas"] = {"bytes": plan.total_bytes(2), "tile_bytes": plan.tile_bytes(2)}
    manifest["generator"] = manifests.generator(plan, asdict(options))
    manifest["water_source"] = manifests.water_block()
    manifest["level_sources"] = {r["source"]: r["count"] for r in levels.groupBy("source").count().collect()}
    catalog.write_manifest(out, "manifest.json", manifest)
    return manifest


def _stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def label_levels(named: DataFrame, plan: GridPlan, sy: int, sx: int) -> DataFrame:
    """``level, row, col, label``: each level from the labels and codes of the one below: the label of the lowest child, the lower label among equals."""
    parts, now, ny, nx = [], named.select("row", "col", "code", "label"), sy, sx
    for k in range(plan.num_levels):
        now = written(now, "labels")
        parts.append(now.select(F.lit(k).alias("level"), "row", "col", "label"))
        if k + 1 < plan.num_levels:
            coarse = stencil.decimate(now.withColumn("h", F.col("code").cast("double")), ny, nx).select("row", "col", F.rint("h").cast("int").alias("code"))
            now = stencil.downsample_label(now, ny, nx).join(coarse, ["row", "col"]).select("row", "col", "code", "label")
            ny, nx = stencil.half(ny), stencil.half(nx)
    return _stacked(parts)


def write_labels(named: DataFrame, plan: GridPlan, sy: int, sx: int, path: str) -> int:
    """The labels of all levels as an atlas of u32."""
    levels = label_levels(named, plan, sy, sx).withColumnRenamed("label", "value")
    return binary.write_atlas(binary.tiles(levels, plan, "<u4"), plan, 4, path)


def write_flow(way: DataFrame, plan: GridPlan, path: str) -> int:
    """Flow directions of the finest level as an atlas of bytes."""
    finest = replace(plan, num_levels=1)
    levels = way.select(F.lit(0).alias("level"), "row", "col", F.coalesce("flow", F.lit(0)).alias("value"))
    return binary.write_atlas(binary.tiles(levels, finest, "u1"), finest, 1, path)


def write_nodes(tree: DataFrame, path: str, low: float, high: float) -> int:
    """The tree as a record file, in order of its nodes."""
    metres = lambda c: low + c / 65535 * (high - low) if c is not None else 0.0
    some = lambda v: binary.NONE if v is None else v
    flags = lambda r: r["leaf"] * 1 | (r["spill_code"] is not None) * 2 | (r["parent"] == 0) * 4
    rows = (
        (some(r["parent"]), some(r["overflow_to"]), some(r["floor_cell"]), some(r["spill_cell"]), some(r["outlet_cell"]), r["cells"], r["subtree_cells"], r["floor_code"] or 0, r["spill_code"] or 0, metres(r["floor_code"]), metres(r["spill_code"]), 0.0, 0, flags(r), 0.0)
        for r in binary.ordered(tree, "node")
    )
    n = tree.count()
    return binary.write_table(path, "hierarchy", (1, binary.NODE.itemsize, n, 0, 0, 0, 0, 0), binary.NODE, rows)


def validate(out: str) -> list[str]:
    """What is wrong with an export's files."""
    manifest = catalog.read_manifest(out, "manifest.json", FORMAT)
    plan = GridPlan(**manifest["plan"])
    errors = [f"{n}: {e}" for n in ("heights", "water_id", "surface") for e in binary.check_atlas(f"{out}/{n}.atlas", plan, 2)]
    if os.path.exists(f"{out}/hierarchy.bin"):
        head, nodes = binary.read_table(f"{out}/hierarchy.bin", "hierarchy", binary.NODE)
        errors += ["hierarchy: the header counts other nodes"] if head[2] != len(nodes) else []
        errors += ["hierarchy: cells don't add up"] if nodes["cell_count"].sum() != plan.samples_x * plan.samples_y else []
        errors += [f"hierarchy: {manifest['statistics']['tree_errors']} nodes contradict their parents"] if manifest["statistics"].get("tree_errors") else []
    binary.read_lake_runs(f"{out}/lake_cells.bin")
    return errors
