"""Exports: reading what a job wrote, by the places that the lattice fixes, and checking it."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import codecs
from tarn.operators import lakes
from tarn.plans.lattice import GridPlan, bounds, outline
from tarn.sources import binary, catalog, network

MANIFEST, FORMAT = "manifest.json", "terrain-export-1"
#: Bytes of a sample in each atlas; the flow atlas has the finest level only. Fixed values.
ATLASES = {"heights": "<u2", "surface": "<u2", "water_id": "<u2", "labels": "<u4", "flowdir": "u1"}
CLASSES = ("dry", "lake", "river", "ocean")


@dataclass
class Export:
    """A finished export: its folder, manifest and lattice."""

    folder: str
    manifest: dict
    plan: GridPlan

    @classmethod
    def load(cls, folder: str) -> Export:
        manifest = catalog.read_manifest(folder, MANIFEST, FORMAT)
        return cls(folder, manifest, GridPlan(**manifest["plan"]))

    def path(self, kind: str) -> str:
        return os.path.join(self.folder, f"{kind}.atlas")

    def has(self, kind: str) -> bool:
        return os.path.exists(self.path(kind))

    def atlas_plan(self, kind: str) -> GridPlan:
        return replace(self.plan, num_levels=1) if kind == "flowdir" else self.plan

    def read_level(self, kind: str, level: int = 0) -> np.ndarray:
        return binary.read_level(self.path(kind), self.atlas_plan(kind), level, ATLASES[kind])

    def read_heights(self, level: int = 0) -> np.ndarray:
        low, high = self.manifest["height_min"], self.manifest["height_max"]
        return low + self.read_level("heights", level) / 65535 * (high - low)

    def read_surface(self, level: int = 0) -> np.ndarray:
        """Water levels in metres, NaN where there is none."""
        low, high = self.manifest["height_min"], self.manifest["height_max"]
        codes = self.read_level("surface", level)
        return np.where(codes == codecs.NO_SURFACE, np.nan, low + codes / 65534 * (high - low))

    def read_water(self, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Class and lake number of each sample."""
        codes = self.read_level("water_id", level).astype(np.int64)
        lake = codes >= codecs.LAKE_BASE
        kind = np.select([lake, codes == codecs.RIVER, codes == codecs.OCEAN], [codecs.CLASS_LAKE, codecs.CLASS_RIVER, codecs.CLASS_OCEAN], codecs.CLASS_DRY)
        return kind, np.where(lake, codes - codecs.LAKE_BASE, 0)

    def level_cells(self, spark: SparkSession, kind: str, level: int = 0, columns: str = "value") -> DataFrame:
        """``row, col, value`` of a level, read by tasks: each gets the places of some tiles and reads those bytes, so the folder must be one that all see."""
        plan, path, dtype = self.atlas_plan(kind), self.path(kind), ATLASES[kind]
        width = np.dtype(dtype).itemsize
        sx, _ = plan.level_samples(level)
        across, along = plan.tiles_at(level)
        rows = [(plan.tile_offset(level, x, y, width), *plan.tile_rows(level, x, y)[:2], int(y == 0), int(x == across - 1)) for y in range(along) for x in range(across)]
        n, size = plan.tile_samples, plan.tile_bytes(width)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                with open(path, "rb") as f:
                    for at, row, col, south, east in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        f.seek(at)
                        data = f.read(size)
                        if len(data) < size:
                            raise ValueError(f"{path} ends in the tile at byte {at}")
                        # A sample on a shared edge comes from the tile north or east of it.
                        tile = np.frombuffer(data, dtype).reshape(n, n)[: n if south else n - 1, : n if east else n - 1]
                        r, c = np.divmod(np.arange(tile.size), tile.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array((row + r).astype(np.int32)), pa.array((col + c).astype(np.int32)), pa.array(tile.ravel().astype(np.int64))], ["row", "col", columns])

        places = spark.createDataFrame(rows, "at long, row int, col int, south int, east int").repartition(min(len(rows), 64))
        return places.mapInArrow(run, f"row int, col int, {columns} long")

    def files(self) -> list[tuple[str, int]]:
        """Every file with its bytes, the largest first."""
        found = [os.path.join(d, f) for d, _, names in os.walk(self.folder) for f in names]
        return sorted(((os.path.relpath(p, self.folder), os.path.getsize(p)) for p in found), key=lambda x: (-x[1], x[0]))

    def preview_level(self, most: int) -> int:
        """The finest level whose longer axis has at most ``most`` samples, else the coarsest."""
        fit = [k for k in range(self.plan.num_levels) if max(self.plan.level_samples(k)) <= most]
        return fit[0] if fit else self.plan.num_levels - 1

    def summary(self) -> dict:
        """The export's head lines."""
        p, m = self.plan, self.manifest
        x0, y0, x1, y1 = p.extent
        return {
            "folder": self.folder, "created_utc": m.get("created_utc"), "epsg": p.epsg, "spacing_m": p.spacing_m, "tile_cells": p.tile_cells, "leaf_tiles": (p.leaf_tiles_x, p.leaf_tiles_y), "num_levels": p.num_levels,
            "tiles_total": p.total_tiles(), "height_min_m": m["height_min"], "height_max_m": m["height_max"], "width_m": x1 - x0, "height_m": y1 - y0, "area_km2": (x1 - x0) * (y1 - y0) / 1e6,
            "bounds_lonlat": bounds(p), "outline_latlon": outline(p), "bytes_total": sum(n for _, n in self.files()), "statistics": m.get("statistics", {}),
        }

    def class_at(self, x: float, y: float) -> str:
        """The water class of the sample nearest to a point: one tile is read, by its place."""
        p = self.plan
        col, up = round((x - p.origin_x) / p.spacing_m), round((y - p.origin_y) / p.spacing_m)
        if not self.has("water_id"):
            return "unknown"
        if not (0 <= col < p.samples_x and 0 <= up < p.samples_y):
            return "outside"
        code = self._sample("water_id", col, up)
        return CLASSES[codecs.CLASS_LAKE] if code >= codecs.LAKE_BASE else CLASSES[{codecs.RIVER: codecs.CLASS_RIVER, codecs.OCEAN: codecs.CLASS_OCEAN}.get(code, codecs.CLASS_DRY)]

    def _sample(self, kind: str, col: int, up: int) -> int:
        p, width = self.plan, np.dtype(ATLASES[kind]).itemsize
        tx, ty = min(col // p.tile_cells, p.leaf_tiles_x - 1), min(up // p.tile_cells, p.leaf_tiles_y - 1)
        at = p.tile_offset(0, tx, ty, width) + ((p.tile_cells - (up - ty * p.tile_cells)) * p.tile_samples + col - tx * p.tile_cells) * width
        with open(self.path(kind), "rb") as f:
            f.seek(at)
            return int(np.frombuffer(f.read(width), ATLASES[kind])[0])

    def height_at(self, col: int, up: int) -> float:
        low, high = self.manifest["height_min"], self.manifest["height_max"]
        return low + self._sample("heights", col, up) / 65535 * (high - low)


def check_points(export: Export, known: Callable[[float, float], float | None], *, n: int = 12, seed: int = 0) -> dict:
    """Packed heights of ``n`` random samples against ``known``, a height by world coordinates from elsewhere; None has none. In carved water the packed bed is meant to be lower, which ``water_class`` tells."""
    rng, p = np.random.default_rng(seed), export.plan
    out: dict = {"quantisation_m": (export.manifest["height_max"] - export.manifest["height_min"]) / 65535, "samples": [], "errors": []}
    for _ in range(n):
        col, up = int(rng.integers(p.samples_x)), int(rng.integers(p.samples_y))
        x, y = p.origin_x + col * p.spacing_m, p.origin_y + up * p.spacing_m
        try:
            want = known(x, y)
        except Exception as error:  # noqa: BLE001  reported, not raised
            out["errors"].append(f"the point at {x}, {y}: {error}")
            break
        if want is not None:
            got = export.height_at(col, up)
            out["samples"].append({"x": x, "y": y, "packed_m": got, "known_m": want, "abs_error_m": abs(got - want), "water_class": export.class_at(x, y)})
    errors = [s["abs_error_m"] for s in out["samples"]]
    return out | {"ok": not out["errors"], "median_abs_error_m": float(np.median(errors)) if errors else None, "max_abs_error_m": max(errors, default=None)}


def write_lake_indexes(spark: SparkSession, folder: str) -> dict:
    """Make an export's lake indexes anew from its own atlases, and name them in its manifest: runs of cells of each lake, and samples of each label and lake with a level (if there are labels)."""
    export = Export.load(folder)
    codes = export.level_cells(spark, "water_id").where(F.col("value") >= codecs.LAKE_BASE).select("row", "col", (F.col("value") - codecs.LAKE_BASE).cast("int").alias("lake_id"))
    runs = lakes.lake_runs(codes, export.plan.samples_x)
    blocks = {"lake_cells": {"file": "lake_cells.bin", "lakes": binary.write_lake_runs(os.path.join(folder, "lake_cells.bin"), runs), "samples": codes.count()}}
    if export.has("labels"):
        labels = export.level_cells(spark, "labels", columns="label").where((F.col("label") > 0) & (F.col("label") < binary.NONE))
        authored = spark.createDataFrame([(i,) for i in authored_lakes(os.path.join(folder, "lakes.json"))], "lake_id int")
        counts = lakes.lake_label_counts(codes.join(labels, ["row", "col"]), authored)
        blocks["lake_samples"] = {"file": "lake_samples.bin", "records": binary.write_lake_samples(os.path.join(folder, "lake_samples.bin"), counts)}
    export.manifest["lake_indexes"] = blocks
    catalog.write_manifest(folder, MANIFEST, export.manifest)
    return blocks


def authored_lakes(path: str) -> list[int]:
    """Numbers of lakes.json's lakes with a positive, finite level; none without the file."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)["lakes"]
    good = lambda v: isinstance(v, (int, float)) and 0 < v < float("inf")
    return sorted(r["lake_id"] for r in rows if good(r.get("authored_level_m")))


def check_water(folder: str) -> dict:
    """What is wrong with an export's water products: rivers that don't parse, counts that differ, links and lakes that aren't there, discharge that shrinks downstream, nodes beyond the tree."""
    export, errors = Export.load(folder), []
    path = os.path.join(folder, "rivers.bin")
    if not os.path.exists(path):
        return {"ok": True, "skipped": "built without rivers"}
    try:
        head, rows = network.read_rivers(path)
    except (ValueError, OSError) as error:
        return {"ok": False, "errors": [str(error)]}
    said = export.manifest.get("network", {}).get("rivers", {})
    for name, got in (("segments", len(rows)), ("vertices", sum(len(r["vertices"]) for r in rows))):
        if name in said and said[name] != got:
            errors.append(f"{got} {name}, {said[name]} in the manifest")
    if head["vertices"] != sum(len(r["vertices"]) for r in rows):
        errors.append("the header counts other vertices")
    by_id = {r["seg_id"]: r for r in rows}
    numbers = {r["lake_id"] for r in json.load(open(os.path.join(folder, "lakes.json"), encoding="utf-8"))["lakes"]} if os.path.exists(os.path.join(folder, "lakes.json")) else None
    nodes = export.manifest.get("statistics", {}).get("nodes")
    for r in rows:
        own = f"segment {r['seg_id']}"
        below = by_id.get(r["downstream"])
        if r["downstream"] >= 0 and below is None:
            errors.append(f"{own}: no segment {r['downstream']} downstream")
        if below is not None and r["seg_id"] not in below["upstream"]:
            errors.append(f"{own}: the one downstream doesn't name it")
        if below is not None and below["discharge"] < r["discharge"] * (1 - 1e-6):
            errors.append(f"{own}: less discharge downstream")
        if not (np.isfinite(r["discharge"]) and r["discharge"] >= 0 and r["width"] > 0):
            errors.append(f"{own}: a discharge or width that can't be")
        if nodes is not None and r["node_id"] != binary.NONE and r["node_id"] >= nodes:
            errors.append(f"{own}: no node {r['node_id']}")
        for a, b, lake in r["spans"]:
            if not 0 <= a <= b < len(r["vertices"]) or (numbers is not None and lake not in numbers):
                errors.append(f"{own}: a span of {a} to {b} in lake {lake}")
    if numbers is not None and os.path.exists(os.path.join(folder, "junctions.json")):
        with open(os.path.join(folder, "junctions.json"), encoding="utf-8") as f:
            errors += [f"junction in lake {j['lake_id']}, which isn't there" for j in json.load(f)["junctions"] if j["lake_id"] not in numbers]
    wide = os.path.join(folder, "river_widths.bin")
    if os.path.exists(wide):
        widths = network.read_widths(wide)
        if set(widths) != set(by_id) or any(len(v) != len(by_id[k]["vertices"]) for k, v in widths.items()):
            errors.append("river_widths.bin has other segments or vertices")
    if os.path.exists(os.path.join(folder, "lake_islands.bin")):
        binary.read_cells(os.path.join(folder, "lake_islands.bin"))
    return {"ok": not errors, "errors": errors, "segments": len(rows), "lakes": len(numbers or ())}


def write_audit(folder: str, summary: dict, lake_rows: DataFrame, river_rows: DataFrame, depressions: DataFrame) -> dict:
    """water_audit.json: the summary, then every lake, river finding and listed depression as records, streamed one by one."""
    path = os.path.join(folder, "water_audit.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps({"format": "terrain-water-audit/1", "summary": summary})[:-1])
        for name, rows in (("lakes", lake_rows), ("rivers", river_rows), ("depressions", depressions)):
            f.write(f', "{name}": [')
            for k, r in enumerate(rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).toLocalIterator()):
                f.write((", " if k else "") + r["j"])
            f.write("]")
        f.write("}")
    return {"file": "water_audit.json", "bytes": os.path.getsize(path), "summary": summary}
