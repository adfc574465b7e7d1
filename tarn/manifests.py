"""What an export says of itself: its parts, the settings and outcomes of a run, and where they come from."""

from __future__ import annotations

from importlib.metadata import PackageNotFoundError, version

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import hydraulics
from tarn.operators import hierarchy
from tarn.plans.lattice import GridPlan
from tarn.sources import binary


def tool_version(package: str = "tarn") -> str:
    """The installed version, or ``unpackaged``."""
    try:
        return version(package)
    except PackageNotFoundError:
        return "unpackaged"


def generator(plan: GridPlan, settings: dict) -> dict:
    """Who made an export, on which lattice, under which settings."""
    return {"tool": "tarn", "version": tool_version(), "crs": f"EPSG:{plan.epsg}", "spacing_m": plan.spacing_m, "samples": [plan.samples_x, plan.samples_y], "settings": settings}


def tree_block(tree: DataFrame, step_m: float, *, minor_m: float = 0.5, minor_m2: float = 250.0, cell_area: float = 1.0) -> dict:
    """The hierarchy in numbers. Tree: ``node, parent, leaf, floor_code, spill_code, subtree_cells``; a node is minor by its depth or its area."""
    depth, area = (F.col("spill_code") - F.col("floor_code")) * step_m, F.col("subtree_cells") * cell_area
    own = tree.where("node > 0")
    minor = (depth < minor_m) | (area < minor_m2)
    row = own.agg(F.count(F.lit(1)).alias("nodes"), F.count_if("leaf").alias("leaves"), F.count_if(minor).alias("minor"), F.count_if(F.col("parent") == 0).alias("off_map"), F.max(depth).alias("deepest_m"), F.median(depth).alias("median_m")).first()
    return {
        "file": "hierarchy.bin", "record_bytes": binary.NODE.itemsize, "node_count": row["nodes"] + 1, "leaf_count": row["leaves"], "minor": row["minor"], "draining_off_map": row["off_map"],
        "depth_m": {"max": row["deepest_m"], "median": row["median_m"]}, "minor_rule": {"depth_m": minor_m, "area_m2": minor_m2},
        "node_0": "what drains off the map", "merging": "a parent has a greater number than its children, but for node 0",
    }


def curves_block(nodes: int, size: int) -> dict:
    return {"file": "hypsometry.bin", "record_bytes": binary.CURVE.itemsize, "records": nodes, "bytes": size, "samples": hierarchy.BELOW + hierarchy.ABOVE, "below_spill": hierarchy.BELOW, "above_spill": hierarchy.ABOVE, "axis": "integers, rounded half up: floor to spill, then to the top", "units": "m2"}


def catchments_block(nodes: int, ends: DataFrame, size: int) -> dict:
    """Ends: ``area`` of every end of water, m2."""
    row = ends.agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("total"), F.max("area").alias("most")).first()
    return {"file": "catchments.bin", "records": nodes, "bytes": size, "ends": row["n"], "area_m2": {"total": row["total"], "largest": row["most"]}, "layout": "one f64 for each node, m2"}


def water_block(width_scale: float = 1.0) -> dict:
    """Where water comes from, and what stands in for what isn't known."""
    return {"width_by_order_m": [w * width_scale for w in hydraulics.WIDTH_BY_ORDER], "depth_by_order_m": list(hydraulics.DEPTH_BY_ORDER), "sources": {"rivers": "river network lines", "main_rivers": "main river lines, burned over the others", "lakes": "lake outlines with published levels"}}


def lake_bed_block(model: str, settings: dict, report: dict) -> dict:
    return {"model": model, "settings": settings, "report": report, "rule": "depth = slope x distance x b (1 - exp(-k q / b)), at 0 along the shore, fitted to surveys where there are any"}


def tiles_of(atlas: dict) -> int | None:
    """Tiles of an atlas by its bytes; None where either number isn't known."""
    size, each = atlas.get("bytes"), atlas.get("tile_bytes")
    return int(size // each) if size and each else None


def run_record(manifest: dict, *, out: str, seconds: float, water: bool = True) -> dict:
    """One line of the run log: settings as given and outcomes as reached, flat."""
    stats, options = manifest.get("statistics", {}), manifest.get("options", {})
    levels, audit = manifest.get("level_sources", {}), manifest.get("water_audit", {}).get("summary", {})
    return {
        "at": manifest.get("created_utc"), "seconds": round(seconds, 2), "out": out, "tile_cells": manifest.get("plan", {}).get("tile_cells"), "water": water, **{f"set_{k}": v for k, v in sorted(options.items())},
        "tiles": tiles_of(manifest.get("atlas", {})), "height_min_m": manifest.get("height_min"), "height_max_m": manifest.get("height_max"),
        "lakes_published": levels.get("nve_hoyde"), "lakes_estimated": levels.get("dtm_interior_low"), "lakes_corrected": levels.get("dtm_corrected"), "lakes_raised": levels.get("dtm_raised"),
        "nodes": stats.get("nodes"), "leaves": stats.get("leaves"), "river_segments": manifest.get("network", {}).get("rivers", {}).get("segments"),
        **{f"audit_{k}": v for k, v in sorted(audit.get("lakes_by_status", {}).items())}, "stage_seconds": manifest.get("seconds", {}),
    }
