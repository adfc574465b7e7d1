"""Datasets: what a fetch leaves behind, heights as they came and features unparsed, and how a job gets its cells and lakes from it.

A folder holds ``dataset.json``, ``heights.parquet`` (``row, col, h``), ``features.parquet`` (``layer, pos, feature``) and perhaps ``preview.png``. Features
stay as they came, so that a better reading of them reaches old datasets too.
"""

from __future__ import annotations

import datetime
import os
import shutil
from collections.abc import Callable
from dataclasses import asdict
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.operators import rivers as river_ops
from tarn.operators import spatial, stencil
from tarn.plans.lattice import GridPlan, suggested_name
from tarn.runtime import ship, written
from tarn.sources import catalog, features, fetch, previews

FORMAT, MANIFEST = "terrain-dataset-1", "dataset.json"
RIVERS, MAIN_RIVERS, LAKES = "rivers", "main_rivers", "lakes"
SURVEYS = ("surveys", "contours", "points", "shores")
WIDTHS = "land_cover"
#: What the fields that are read may be called; the first is the usual name. Fixed values.
RIVER_FIELDS = {"id": ("strekninglnr", "strekn_lnr"), "order": ("elveordenstrahler", "strahler", "orden"), "river_no": ("vassdragsnr",), "date": ("statusdatofra", "date")}
LAKE_FIELDS = {"id": ("vatnlnr", "lopenr"), "name": ("navn", "innsjonavn"), "level": ("hoyde", "hoyde_moh"), "area": ("areal_km2", "areal"), "kind": ("objekttype", "type")}
#: Orders of lines that name none, in the whole network and among the main rivers.
MINOR, MAIN = 2, 5


def height_stats(heights: DataFrame, samples: int) -> dict:
    """Least, greatest and mean height, samples without one, and the share that has one."""
    low, high, mean, n = heights.agg(F.min("h"), F.max("h"), F.avg("h"), F.count("h")).first()
    return {"min_m": low, "max_m": high, "mean_m": mean, "nodata": samples - n, "coverage_pct": 100 * n / samples}


def layer_counts(raw: DataFrame) -> dict[str, int]:
    """Features of each layer; those of land cover by kind, and by width class where they have one."""
    p = "$.properties."
    kind, width = F.get_json_object("feature", p + "objtype"), F.get_json_object("feature", p + "vannbredde")
    key = F.when(F.col("layer") == WIDTHS, F.concat_ws("_", kind, width)).otherwise(F.col("layer"))
    return {r["key"]: r["n"] for r in raw.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy("key").toLocalIterator()}


def write(spark: SparkSession, folder: str, plan: GridPlan, heights: DataFrame, raw: DataFrame, *, name: str, source: dict | None = None, request: dict | None = None, preview: bytes | None = None) -> dict:
    """Write a dataset and return its manifest. Heights: ``row, col, h`` (null: none) of the whole lattice; raw: ``layer, pos, feature``."""
    os.makedirs(folder, exist_ok=True)
    heights.write.mode("overwrite").parquet(f"{folder}/heights.parquet")
    raw.write.mode("overwrite").parquet(f"{folder}/features.parquet")
    if preview:
        with open(os.path.join(folder, "preview.png"), "wb") as f:
            f.write(preview)
    stats = height_stats(spark.read.parquet(f"{folder}/heights.parquet"), plan.samples_x * plan.samples_y)
    manifest = {
        "format": FORMAT,
        "name": name,
        "slug": os.path.basename(os.path.normpath(folder)),
        "created_utc": datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "plan": asdict(plan),
        "source": source or {},
        "request": request or {},
        "heights": stats,
        "layers": layer_counts(spark.read.parquet(f"{folder}/features.parquet")),
        "preview": "preview.png" if preview else None,
    }
    manifest["bytes_total"] = catalog.folder_bytes(folder)
    catalog.write_manifest(folder, MANIFEST, manifest)
    return manifest


def load(folder: str) -> tuple[dict, GridPlan]:
    """A dataset's manifest and lattice; another format raises."""
    manifest = catalog.read_manifest(folder, MANIFEST, FORMAT)
    return manifest, GridPlan(**manifest["plan"])


def resolve(spec: str, root: str) -> str:
    """The folder of a dataset given by its path, its folder's name under ``root``, or its name; none raises with what there is."""
    for folder in (spec, os.path.join(root, spec)):
        if os.path.exists(os.path.join(folder, MANIFEST)):
            return folder
    found = catalog.list_folders(root, MANIFEST)
    for folder, manifest in found:
        if spec in (manifest.get("slug"), manifest.get("name")):
            return folder
    raise LookupError(f"no dataset {spec!r} in {root}; there are: {', '.join(str(m.get('slug')) for _, m in found) or 'none'}")


def replace_layers(spark: SparkSession, folder: str, raw: DataFrame, layers: tuple[str, ...]) -> dict:
    """Put new features of some layers into a dataset, in place of what it has of them; heights stay. The new table is whole before the old one goes."""
    manifest, _ = load(folder)
    kept = spark.read.parquet(f"{folder}/features.parquet").where(~F.col("layer").isin(*layers))
    fresh = f"{folder}/features.new"
    kept.unionByName(raw.where(F.col("layer").isin(*layers))).write.mode("overwrite").parquet(fresh)
    shutil.rmtree(f"{folder}/features.parquet")
    os.rename(fresh, f"{folder}/features.parquet")
    manifest["layers"] = layer_counts(spark.read.parquet(f"{folder}/features.parquet"))
    manifest["bytes_total"] = catalog.folder_bytes(folder)
    catalog.write_manifest(folder, MANIFEST, manifest)
    return manifest


def picture(heights: DataFrame, plan: GridPlan, most: int = 512) -> bytes:
    """The thumbnail of a lattice: shaded, thinned in Spark."""
    shape = (plan.samples_y, plan.samples_x)
    step = previews.stride_for(shape, most)
    sy, sx = -(-shape[0] // step), -(-shape[1] // step)
    small = previews.thin(heights, shape, most)
    shade = stencil.hillshade(small, sy, sx, plan.spacing_m * step)
    out, lit = np.full((sy, sx), np.nan), np.full((sy, sx), 0.5)
    for r in small.join(shade.select("row", "col", "shade"), ["row", "col"], "left").toLocalIterator():
        if r["h"] is not None:
            out[r["row"], r["col"]] = r["h"]
        if r["shade"] is not None:
            lit[r["row"], r["col"]] = r["shade"]
    return previews.thumbnail(out, lit, plan.extent)


def run_fetch(
    spark: SparkSession, plan: GridPlan, root: str, fetcher: Callable, raw: DataFrame | None = None, *, name: str | None = None, folder: str | None = None, server: str = "", most: int = fetch.CHUNK, preview: bool = True, request: dict | None = None, demo: bool = False
) -> str:
    """Stage one: heights by requests, features as given, written as a dataset; returns its folder. Chunks that came are kept until the dataset is whole."""
    ship(spark)
    name = name or suggested_name(plan)
    folder = folder or catalog.unique_dir(root, catalog.slugify(name))
    cache = fetch.cache_dir(root, plan, server)
    heights = written(fetch.read_heights(spark, plan, fetcher, most=most, cache=cache), "heights")
    raw = raw if raw is not None else fetch.raw_features(spark, iter(()), "none")
    write(spark, folder, plan, heights, raw, name=name, source={"server": server, "demo": demo}, request=request, preview=picture(heights, plan) if preview else None)
    shutil.rmtree(cache, ignore_errors=True)
    return folder


def demo_layers(spark: SparkSession, plan: GridPlan) -> DataFrame:
    made = fetch.demo_features(plan)
    return reduce(DataFrame.union, [fetch.raw_features(spark, iter(made[k]), k) for k in (RIVERS, MAIN_RIVERS, LAKES)])


def _parsed(raw: DataFrame, layer: str) -> DataFrame:
    return features.parse_features(raw.where(F.col("layer") == layer).select("pos", F.col("feature").alias("raw")))


def _names(parsed: DataFrame, wanted: dict) -> dict:
    """Which field holds what, by the names that occur in the layer: schemas are small, so they come to the driver."""
    keys = [r[0] for r in parsed.select(F.explode(F.map_keys("properties")).alias("k")).distinct().orderBy("k").toLocalIterator()]
    return river_ops.resolve_fields(keys, wanted)


def lake_cells(raw: DataFrame, plan: GridPlan) -> tuple[DataFrame, DataFrame]:
    """``row, col, lake_id`` of samples in lakes, and the lakes, ``lake_id, lake_no, name, published, area_m2, regulated``. A lake's number is the place of its first outline; later outlines win where they overlap."""
    parsed = written(_parsed(raw, LAKES), "lakes")
    table = features.lake_attributes(parsed, _names(parsed, LAKE_FIELDS))
    first = table.groupBy(F.coalesce(F.col("lake_no"), -F.col("pos") - 1).alias("own")).agg(F.min("pos").alias("first"))
    # Lakes of a region are numbered by one task: a number fits 16 bits in the products anyway.
    numbered = first.withColumn("lake_id", F.row_number().over(Window.orderBy("first")))
    named = table.withColumn("own", F.coalesce(F.col("lake_no"), -F.col("pos") - 1)).join(numbered, "own")
    along = Window.partitionBy("pos", "ring").orderBy("ord")
    x, y = (F.col("x") - plan.origin_x) / plan.spacing_m, (plan.samples_y - 1) - (F.col("y") - plan.origin_y) / plan.spacing_m
    corners = features.polygon_rings(parsed).select("pos", "ring", "ord", x.alias("x0"), y.alias("y0"))
    edges = corners.withColumns({"x1": F.lead("x0").over(along), "y1": F.lead("y0").over(along)}).where("x1 is not null").withColumn("id", F.col("pos"))
    inside = spatial.raster_polygons(edges.select("id", "x0", "y0", "x1", "y1"), plan.samples_y, plan.samples_x)
    owned = inside.groupBy("row", "col").agg(F.max("id").alias("pos")).join(named.select("pos", "lake_id"), "pos").select("row", "col", "lake_id")
    lakes = named.where(F.col("pos") == F.col("first")).select("lake_id", "lake_no", "name", "published", "area_m2", "regulated")
    return owned, lakes


def river_lines(raw: DataFrame, layer: str = RIVERS, default: int = MINOR) -> DataFrame:
    """``seg_id`` (place of the feature and part)``, pos, order, feature_id, river_no`` of the lines of a layer: of records with the same coordinates the newest counts, at the first one's place."""
    parsed = written(_parsed(raw, layer), "lines")
    own = features.river_attributes(parsed, _names(parsed, RIVER_FIELDS), default)
    rows = parsed.join(own, "pos").select("pos", "kind", "coordinates", "feature_id", "order", "river_no", "date")
    best = river_ops.dedupe_versions(rows, "coordinates", "date", "feature_id")
    return best.select("pos", "kind", "coordinates", "feature_id", "order", "river_no")


def river_cells(raw: DataFrame, plan: GridPlan, widths: tuple[float, ...]) -> DataFrame:
    """``row, col, order`` of samples in rivers: lines as wide as their order says, main rivers over the others."""
    parts = []
    for layer, default, rank in ((RIVERS, MINOR, 0), (MAIN_RIVERS, MAIN, 1)):
        lines = river_lines(raw, layer, default)
        vertices = features.line_vertices(lines).join(lines.select("pos", "order"), "pos")
        x, y = (F.col("x") - plan.origin_x) / plan.spacing_m, (plan.samples_y - 1) - (F.col("y") - plan.origin_y) / plan.spacing_m
        placed = vertices.select("pos", "part", "ord", "order", x.alias("x0"), y.alias("y0"))
        along = Window.partitionBy("pos", "part").orderBy("ord")
        ahead = placed.withColumns({"x1": F.lead("x0").over(along), "y1": F.lead("y0").over(along)}).where("x1 is not null")
        width = F.element_at(F.array(*map(F.lit, widths)), F.least(F.col("order"), F.lit(len(widths)))) / plan.spacing_m
        parts.append(ahead.select((F.col("pos") * 2 + rank).alias("id"), "ord", "order", width.alias("width"), "x0", "y0", "x1", "y1"))
    pieces = written(parts[0].unionByName(parts[1]), "pieces")
    covered = spatial.raster_lines(pieces, plan.samples_y, plan.samples_x)
    return covered.join(pieces.groupBy("id").agg(F.max("order").alias("order")), "id").select("row", "col", "order")


def prepared(spark: SparkSession, folder: str, widths: tuple[float, ...]) -> tuple[GridPlan, DataFrame, DataFrame]:
    """What a job needs of a dataset: its lattice, cells ``row, col, h, kind, lake_id`` (kind 2 in lakes, 1 in rivers, 0 on land), and lakes ``lake_id, published, regulated``."""
    _, plan = load(folder)
    raw = spark.read.parquet(f"{folder}/features.parquet")
    inside, lakes = lake_cells(raw, plan)
    wet = river_cells(raw, plan, widths)
    heights = spark.read.parquet(f"{folder}/heights.parquet")
    rows = heights.join(inside, ["row", "col"], "left").join(wet, ["row", "col"], "left")
    kind = F.when(F.col("lake_id").isNotNull(), 2).when(F.col("order").isNotNull(), 1).otherwise(0)
    cells = rows.select("row", "col", "h", kind.alias("kind"), F.coalesce("lake_id", F.lit(0)).alias("lake_id"))
    return plan, written(cells, "cells"), written(lakes.select("lake_id", "published", "regulated"), "lakes")
