"""The products of a river network: rivers, widths and branches in their binary layouts, lakes and junctions as JSON, and a GeoJSON to look at.

A segment is one row: ``seg_id, strekn_lnr, vatn_lnr, order, downstream, discharge, width, node_id, upstream`` (ids)``, elvid, vassdragsnr,
spans`` (a, b, lake_id)``, geom_hash`` (32 hex digits)``, vertices`` (x, y, z, level), and perhaps ``vertex_width``. Rows are packed by tasks; the
driver only joins the packed rows in the order of their ids, a partition at a time.
"""

from __future__ import annotations

import json
import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.plans.lattice import GridPlan
from tarn.sources.binary import MAGIC, NONE, ordered
from tarn.sources.catalog import write_manifest

#: Layouts of the headers and of a segment; fixed values.
RIVERS_HEAD, RIVERS_PREFIX, SPAN = struct.Struct("<8sIIddfIII"), struct.Struct("<IqqHiffI"), struct.Struct("<IIH")
WIDTHS_HEAD, WIDTHS_PREFIX = struct.Struct("<8sIII"), struct.Struct("<II")
RIVERS_VERSION, WIDTHS_VERSION = 2, 1


def packed_string(text: str | None) -> bytes:
    """A length byte and at most 255 ASCII characters; others become question marks."""
    data = (text or "").encode("ascii", "replace")[:255]
    return bytes([len(data)]) + data


def _river(row: dict, origin: tuple[float, float]) -> bytes:
    none = lambda v: -1 if v is None else int(v)
    node = NONE if row["node_id"] is None else row["node_id"]
    xyzl = np.array([[v["x"] - origin[0], v["y"] - origin[1], v["z"], v["level"]] for v in row["vertices"]], "<f4")
    parts = [
        RIVERS_PREFIX.pack(row["seg_id"], none(row["strekn_lnr"]), none(row["vatn_lnr"]), row["order"], none(row["downstream"]), row["discharge"], row["width"], node),
        struct.pack("<H", len(row["upstream"])) + np.array(row["upstream"], "<u4").tobytes(),
        packed_string(row["elvid"]) + packed_string(row["vassdragsnr"]),
        struct.pack("<H", len(row["spans"])) + b"".join(SPAN.pack(s["a"], s["b"], s["lake_id"]) for s in row["spans"]),
        bytes.fromhex(row["geom_hash"]) + struct.pack("<I", len(xyzl)) + xyzl.tobytes(),
    ]
    return b"".join(parts)


def _widths(row: dict) -> bytes:
    own, n = row.get("vertex_width"), len(row["vertices"])
    widths = own if own is not None and len(own) == n else [row["width"] or 0.0] * n
    return WIDTHS_PREFIX.pack(row["seg_id"], n) + np.array(widths, "<f4").tobytes()


def packed(segments: DataFrame, plan: GridPlan) -> DataFrame:
    """``seg_id, n`` (vertices)``, river, widths``: each segment as it lies in the two files. Rows of Arrow batches are packed one by one; a segment is one value."""
    origin = (plan.origin_x, plan.origin_y)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            columns = [pa.array([r["seg_id"] for r in rows], pa.int64()), pa.array([len(r["vertices"]) for r in rows], pa.int64()), pa.array([_river(r, origin) for r in rows], pa.binary()), pa.array([_widths(r) for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["seg_id", "n", "river", "widths"])

    return segments.mapInArrow(run, "seg_id long, n long, river binary, widths binary")


def _written(path: str, head: bytes, rows: DataFrame, column: str) -> int:
    with open(path, "wb") as f:
        size = f.write(head)
        for row in ordered(rows.select("seg_id", column), "seg_id"):
            size += f.write(row[column])
    return size


def write_rivers(segments: DataFrame, plan: GridPlan, folder: str, *, stride_m: float, widths: bool) -> dict:
    """rivers.bin, and river_widths.bin if asked for; what the manifest says of them."""
    made = packed(segments, plan)
    many, vertices = made.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    head = RIVERS_HEAD.pack(MAGIC["rivers"], RIVERS_VERSION, plan.epsg, plan.origin_x, plan.origin_y, stride_m, many, vertices, 0)
    out = {"rivers": {"file": "rivers.bin", "segments": many, "vertices": vertices, "bytes": _written(os.path.join(folder, "rivers.bin"), head, made, "river")}}
    if widths:
        head = WIDTHS_HEAD.pack(MAGIC["widths"], WIDTHS_VERSION, many, vertices)
        out["river_widths"] = {"file": "river_widths.bin", "segments": many, "vertices": vertices, "bytes": _written(os.path.join(folder, "river_widths.bin"), head, made, "widths")}
    return out


def read_rivers(path: str) -> tuple[dict, list[dict]]:
    """Header and segments of rivers.bin; bytes that are missing or left over raise. For inspection and tests: it holds the file."""
    with open(path, "rb") as f:
        data = f.read()
    magic, version, epsg, x, y, stride, many, vertices, _ = RIVERS_HEAD.unpack_from(data)
    if magic != MAGIC["rivers"] or version != RIVERS_VERSION:
        raise ValueError(f"{path}: not a river file of version {RIVERS_VERSION}")
    at, rows = RIVERS_HEAD.size, []

    def take(layout: str):
        nonlocal at
        got = struct.unpack_from(layout, data, at)
        at += struct.calcsize(layout)
        return got

    for _ in range(many):
        row = dict(zip(("seg_id", "strekn_lnr", "vatn_lnr", "order", "downstream", "discharge", "width", "node_id"), take(RIVERS_PREFIX.format), strict=True))
        row["upstream"] = list(take(f"<{take('<H')[0]}I"))
        for name in ("elvid", "vassdragsnr"):
            row[name] = take(f"<{take('<B')[0]}s")[0].decode("ascii")
        row["spans"] = [take(SPAN.format) for _ in range(take("<H")[0])]
        row["geom_hash"] = take("<16s")[0].hex()
        n = take("<I")[0]
        row["vertices"] = np.frombuffer(data, "<f4", 4 * n, at).reshape(n, 4)
        at += 16 * n
        rows.append(row)
    if at != len(data):
        raise ValueError(f"{path}: {len(data) - at} bytes too many")
    return {"epsg": epsg, "origin_x": x, "origin_y": y, "stride_m": stride, "vertices": vertices}, rows


def read_widths(path: str) -> dict[int, np.ndarray]:
    with open(path, "rb") as f:
        data = f.read()
    magic, _, many, _ = WIDTHS_HEAD.unpack_from(data)
    if magic != MAGIC["widths"]:
        raise ValueError(f"{path}: not a width file")
    at, out = WIDTHS_HEAD.size, {}
    for _ in range(many):
        seg, n = WIDTHS_PREFIX.unpack_from(data, at)
        out[seg] = np.frombuffer(data, "<f4", n, at + WIDTHS_PREFIX.size)
        at += WIDTHS_PREFIX.size + 4 * n
    return out


def river_feature(plan: GridPlan) -> Column:
    """A segment as a GeoJSON feature, absolute coordinates and levels rounded to centimetres."""
    two = lambda c: F.round(c.cast("double"), 2)
    line = F.transform("vertices", lambda v: F.array(two(v["x"]), two(v["y"]), two(v["z"])))
    names = ("seg_id", "strekn_lnr", "elvid", "vassdragsnr", "vatn_lnr", "geom_hash", "order")
    more = [F.col("downstream").alias("downstream_id"), F.col("upstream").alias("upstream_ids"), F.transform("spans", lambda s: F.array(s["a"].cast("int"), s["b"].cast("int"), s["lake_id"].cast("int"))).alias("lake_spans")]
    more += [F.col("discharge").alias("discharge_m3_s"), F.col("width").alias("width_m"), "node_id", F.transform("vertices", lambda v: two(v["level"])).alias("level_m")]
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"), F.struct(*names, *more).alias("properties")), {"ignoreNullFields": "false"})


def write_rivers_geojson(segments: DataFrame, plan: GridPlan, path: str) -> dict:
    """One feature collection, streamed feature by feature."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": f"urn:ogc:def:crs:EPSG::{plan.epsg}"}}})[:-1] + ', "features": [')
        for k, row in enumerate(ordered(segments.select("seg_id", river_feature(plan).alias("feature")), "seg_id")):
            f.write((", " if k else "") + row["feature"])
        f.write("]}")
    return {"file": os.path.basename(path), "bytes": os.path.getsize(path)}


#: What each source of a lake's level means, told where a lake has it.
LEVEL_SOURCES = {
    "nve_hoyde": "the published level",
    "dtm_interior_low": "the low band of the scanned water inside the lake, held under the shore, where no level is published",
    "dtm_corrected": "as measured, because the published level stands too far above the shore, or above scan and shore",
    "dtm_raised": "as measured, because the published level stands too far below the scanned water",
    "nve_neighbour": "the published level of a lake that touches this one and has the same water",
}


def write_lakes_json(lakes: DataFrame, plan: GridPlan, folder: str, lake_id_base: int = 16) -> dict:
    """lakes.json: one record for each lake (columns as they are, ``level_source`` among them) and a glossary of the sources that occur."""
    records = [json.loads(r["j"]) for r in lakes.orderBy("lake_id").select(F.to_json(F.struct(*lakes.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()]
    used = {r["level_source"] for r in records} | {"nve_hoyde", "dtm_interior_low"}
    write_manifest(folder, "lakes.json", {"format": "terrain-lakes/1", "crs": f"EPSG:{plan.epsg}", "lake_id_base": lake_id_base, "level_sources": {k: v for k, v in LEVEL_SOURCES.items() if k in used}, "lakes": records})
    count = lambda source: sum(r["level_source"] == source for r in records)
    return {"file": "lakes.json", "count": len(records), "with_authored_level": sum(r.get("authored_level_m") is not None for r in records), "with_estimated_level": count("dtm_interior_low"), "with_corrected_level": count("dtm_corrected"), "with_raised_level": count("dtm_raised"), "with_twin_level": count("nve_neighbour")}


def write_junctions_json(junctions: DataFrame, plan: GridPlan, folder: str) -> dict:
    """junctions.json: ``segment_id, strekn_lnr, lake_id, vatn_lnr, type, position`` (x, y, z to centimetres) of each junction, by segment and place."""
    position = F.array(*(F.round(c, 2) for c in ("x", "y", "z")))
    rows = junctions.orderBy("seg_id", "ord").select(F.col("seg_id").alias("segment_id"), "strekn_lnr", "lake_id", "vatn_lnr", F.col("kind").alias("type"), position.alias("position"))
    records = [r.asDict() for r in rows.toLocalIterator()]
    write_manifest(folder, "junctions.json", {"format": "terrain-junctions/1", "crs": f"EPSG:{plan.epsg}", "types": ["inflow", "outflow"], "junctions": records})
    inflow = sum(r["type"] == "inflow" for r in records)
    return {"file": "junctions.json", "count": len(records), "inflow": inflow, "outflow": len(records) - inflow}


def export_network(segments: DataFrame, lakes: DataFrame, junctions: DataFrame, plan: GridPlan, folder: str, *, stride_m: float, geojson: bool = False) -> dict:
    """All products of a network in ``folder``, and their part of the manifest. Widths are written where any segment has its own."""
    os.makedirs(folder, exist_ok=True)
    own = "vertex_width" in segments.columns and not segments.where("vertex_width is not null").isEmpty()
    out = write_rivers(segments, plan, folder, stride_m=stride_m, widths=own)
    out["lakes"] = write_lakes_json(lakes, plan, folder)
    out["junctions"] = write_junctions_json(junctions, plan, folder)
    if geojson:
        out["rivers_geojson"] = write_rivers_geojson(segments, plan, os.path.join(folder, "rivers.geojson"))
    return out


def nested(segments: DataFrame, vertices: DataFrame, spans: DataFrame) -> DataFrame:
    """Segments as rows of the kind this module packs: with arrays of ``vertices`` (``seg_id, ord, x, y, z, level``), ``spans`` and upstream ids. A segment's vertices are one value, as in the file."""
    line = vertices.groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "z", "level"))).alias("v"))
    line = line.select("seg_id", F.transform("v", lambda v: F.struct(*(v[c].cast("double").alias(c) for c in ("x", "y", "z", "level")))).alias("vertices"))
    runs = spans.groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "lake_id"))).alias("spans"))
    feeds = segments.where("downstream is not null").groupBy(F.col("downstream").alias("seg_id")).agg(F.sort_array(F.collect_list("seg_id")).alias("upstream"))
    none = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as {kind})")).alias(c)
    kinds = dict(spans.dtypes)
    both = segments.join(line, "seg_id").join(runs, "seg_id", "left").join(feeds, "seg_id", "left")
    span = f"array<struct<a:{kinds['a']},b:{kinds['b']},lake_id:{kinds['lake_id']}>>"
    return both.select(*segments.columns, "vertices", none("spans", span), none("upstream", f"array<{dict(segments.dtypes)['seg_id']}>"))


def retied(vertices: DataFrame, ends: DataFrame) -> DataFrame:
    """``seg_id, ord, x, y, z, level`` with the levels of branches carried onto their ends: the gaps at both ends are spread over the line by its length.

    Ends: ``seg_id, first_level, last_level, upto``: what a branch is to meet at its first and last vertex (null: nothing), and the last vertex that
    moves, which is where it enters a lake (null: its last).
    """
    along = Window.partitionBy("seg_id").orderBy("ord")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dx, dy = F.col("x") - F.lag("x").over(along), F.col("y") - F.lag("y").over(along)
    rows = vertices.join(ends, "seg_id").withColumn("step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    rows = rows.withColumn("s", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("upto", F.greatest(F.coalesce("upto", F.max("ord").over(whole)), F.lit(1)))
    rows = rows.withColumn("total", F.max(F.when(F.col("ord") <= F.col("upto"), F.col("s"))).over(whole))
    t = F.coalesce(F.try_divide("s", "total"), F.col("ord") / F.col("upto"))
    gap = lambda want, f: F.coalesce(F.col(want) - f("level").over(whole), F.lit(0.0))
    moved = F.col("level") + gap("first_level", F.first) * (1 - t) + gap("last_level", F.last) * t
    tied = rows.select("seg_id", "ord", "x", "y", "z", F.when(F.col("ord") <= F.col("upto"), moved).otherwise(F.col("level")).alias("level"))
    return tied.unionByName(vertices.join(ends.select("seg_id"), "seg_id", "left_anti").select("seg_id", "ord", "x", "y", "z", F.col("level").cast("double").alias("level")))
