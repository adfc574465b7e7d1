"""From river lines as they are mapped to a network: cut to the map, sampled, oriented, linked, with levels, widths and junctions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import codecs, hydraulics
from tarn.operators import downhill, geometry, measures, stencil, walks
from tarn.operators import rivers as river_ops
from tarn.plans.lattice import GridPlan
from tarn.runtime import written


@dataclass
class Traced:
    """Segments ``seg_id, pos, order, downstream, length, unit, area_km2``; vertices ``seg_id, ord, x, y, row, col, ground, lake_id``; spans ``seg_id, a, b, lake_id``."""

    segments: DataFrame
    vertices: DataFrame
    spans: DataFrame


def on_lattice(points: DataFrame, plan: GridPlan) -> DataFrame:
    """``points`` with ``at_row, at_col`` (fractional) and ``row, col`` of the nearest sample."""
    at_row, at_col = codecs.world_to_grid(F.col("x"), F.col("y"), plan)
    return points.withColumn("at_row", at_row).withColumn("at_col", at_col).withColumn("row", codecs.nearest_index(F.col("at_row"), plan.samples_y)).withColumn("col", codecs.nearest_index(F.col("at_col"), plan.samples_x))


def trace(lines: DataFrame, attributes: DataFrame, cells: DataFrame, plan: GridPlan, *, stride_m: float | None = None, rise_m: float = 25.0) -> Traced:
    """Lines (``line, ord, x, y``) with their attributes (``line, order``, and perhaps ``unit, area_km2``) as a network over cells (``row, col, h, lake_id, order``; ``order`` of the river raster, null off it).

    A line is sampled every ``stride_m`` at most and cut into the runs of at least two vertices that lie on the map; runs without any height go. Runs are numbered by
    their line and place. A run that touches no lake and climbs is turned round. Its order is the most frequent along its cells, else its line's.
    An end flows into the run that begins within a cell of it.
    """
    stride = stride_m or plan.spacing_m
    dense = river_ops.densify(lines, stride, key="line")
    along = Window.partitionBy("line").orderBy("ord", "step")
    placed = dense.withColumn("place", F.row_number().over(along) - 1).withColumn("inside", geometry.in_extent(F.col("x"), F.col("y"), plan.extent))
    runs = geometry.true_runs(placed.select("line", F.col("place").alias("ord"), "inside"), "inside", 2, key="line")
    cut = written(placed.join(runs, "line").where((F.col("place") >= F.col("a")) & (F.col("place") < F.col("b"))).select("line", "a", (F.col("place") - F.col("a")).alias("ord"), "x", "y"), "runs")
    named = cut.select("line", "a").distinct().withColumn("seg_id", F.row_number().over(Window.orderBy("line", "a")) - 1)  # one row a run: numbers of the products are u32
    vertices = on_lattice(cut.join(named, ["line", "a"]), plan)
    known = vertices.join(cells.select("row", "col", F.col("h").alias("ground"), "lake_id", F.col("order").alias("cell_order")), ["row", "col"], "left")
    dry = known.groupBy("seg_id").agg(F.count("ground").alias("n")).where("n > 0").select("seg_id")
    known = written(known.join(dry, "seg_id", "left_semi").withColumn("lake_id", F.coalesce("lake_id", F.lit(0))), "vertices")
    turned = river_ops.orient(known.select("seg_id", "line", "ord", F.col("ground").alias("z"), "x", "y", "row", "col", "lake_id", "cell_order"), rise_m)
    vertices = written(turned.withColumnRenamed("z", "ground"), "oriented")
    spans = written(river_ops.lake_spans(vertices.select("seg_id", "ord", "lake_id")), "spans")
    path = geometry.pixel_path(vertices.select("seg_id", "ord", "row", "col"), (plan.samples_y, plan.samples_x))
    orders = path.join(cells.where("order > 0").select("row", "col", "order"), ["row", "col"]).select("seg_id", "order")
    mode = river_ops.mode_order(orders).withColumnRenamed("order", "mode")
    own = vertices.groupBy("seg_id").agg(F.first("line").alias("line"), F.min_by(F.struct("x", "y"), "ord").alias("p"), F.max_by(F.struct("x", "y"), "ord").alias("q"))
    more = [c for c in ("unit", "area_km2") if c in attributes.columns]
    rows = own.join(attributes.select("line", F.col("order").alias("stated"), *more), "line").join(mode, "seg_id", "left").withColumn("order", F.coalesce("mode", "stated"))
    ends = rows.select("seg_id", "order", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("q.x").alias("x1"), F.col("q.y").alias("y1"))
    links = river_ops.link_ends(ends, plan.spacing_m)
    lengths = river_ops.segment_lengths(vertices)
    segments = rows.join(links, "seg_id").join(lengths, "seg_id").select("seg_id", "line", "order", "downstream", "length", *more)
    for c, kind in (("unit", "string"), ("area_km2", "double")):
        if c not in more:
            segments = segments.withColumn(c, F.lit(None).cast(kind))
    return Traced(written(segments, "segments"), vertices, spans)


def with_hydraulics(traced: Traced) -> DataFrame:
    """``traced.segments`` with ``discharge, width, depth``; where no unit's area is known, width and depth follow the order."""
    flow = river_ops.discharge(traced.segments.select("seg_id", "downstream", "unit", "area_km2", "length"))
    rows = traced.segments.join(flow.select("seg_id", "discharge", F.col("width").alias("w"), F.col("depth").alias("d")), "seg_id")
    wet = F.col("discharge") > 0
    return rows.select(*traced.segments.columns, "discharge", F.when(wet, F.col("w")).otherwise(hydraulics.by_order(F.col("order"), hydraulics.WIDTH_BY_ORDER)).alias("width"), F.when(wet, F.col("d")).otherwise(hydraulics.by_order(F.col("order"), hydraulics.DEPTH_BY_ORDER)).alias("depth"))


def shaped(traced: Traced, segments: DataFrame, cells: DataFrame, levels: DataFrame, plan: GridPlan, rules: downhill.Rules = downhill.Rules()) -> DataFrame:
    """``seg_id, ord, surface, bed`` by ``downhill.profiles``: ground along the lines, banks beside them, lakes' levels. Cells: ``row, col, h, kind``; levels: ``lake_id, level``."""
    sy, sx = plan.samples_y, plan.samples_x
    points = on_lattice(traced.vertices.select("seg_id", "ord", "x", "y"), plan)
    ground = stencil.bilinear(points.select(F.struct("seg_id", "ord").alias("id"), "at_row", "at_col"), cells, sy, sx).select("id.seg_id", "id.ord", F.col("h").alias("level"))
    wide = segments.select("seg_id", downhill.half_width(F.col("order"), plan.spacing_m, F.col("width")).alias("half_width"), F.col("depth").alias("carve"))
    grid = points.join(wide.select("seg_id", "half_width"), "seg_id").select("seg_id", "ord", F.col("at_col").alias("x"), F.col("at_row").alias("y"), "half_width")
    banks = downhill.bank_ceilings(grid, cells, sy, sx, plan.spacing_m)
    rows = traced.vertices.select("seg_id", "ord", "x", "y").join(ground, ["seg_id", "ord"]).join(banks, ["seg_id", "ord"], "left").withColumn("trench", F.lit(None).cast("double"))
    spans = traced.spans.join(levels.select("lake_id", "level"), "lake_id", "left")
    order = downhill.flow_order(traced.segments).select("seg_id", "downstream", "rank").join(wide, "seg_id")
    made = downhill.profiles(downhill.lines_of(rows, order, spans), plan.spacing_m, rules)
    both = made.select("seg_id", F.posexplode(F.arrays_zip("surface", "bed")).alias("ord", "v"))
    return both.select("seg_id", "ord", "v.surface", "v.bed")


def network(traced: Traced, segments: DataFrame, bed: DataFrame, levels: DataFrame, plan: GridPlan, *, profile: DataFrame | None = None, surface: DataFrame | None = None, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, vertices (``seg_id, ord, x, y, z, level``) and junctions of the finished network.

    ``z`` is the bed under a vertex; its level is the lake's within a span, else the shaped profile's, else the water raster's (``row, col, surface``), else ``z``. A
    segment's node is that of the sample at its last vertex. Junctions: ``seg_id, ord, kind, lake_id, x, y, z``.
    """
    sy, sx = plan.samples_y, plan.samples_x
    points = on_lattice(traced.vertices.select("seg_id", "ord", "x", "y"), plan)
    z = stencil.bilinear(points.select(F.struct("seg_id", "ord").alias("id"), "at_row", "at_col"), bed, sy, sx).select("id.seg_id", "id.ord", F.col("h").alias("z"))
    rows = points.join(z, ["seg_id", "ord"])
    inside = traced.spans.join(levels.select("lake_id", F.col("level").alias("lake_level")), "lake_id").select("seg_id", F.explode(F.sequence("a", "b")).alias("ord"), "lake_level")
    rows = rows.join(inside, ["seg_id", "ord"], "left")
    rows = rows.join(profile.select("seg_id", "ord", F.col("surface").alias("own")), ["seg_id", "ord"], "left") if profile is not None else rows.withColumn("own", F.lit(None).cast("double"))
    rows = rows.join(surface.select("row", "col", "surface"), ["row", "col"], "left") if surface is not None else rows.withColumn("surface", F.lit(None).cast("double"))
    vertices = written(rows.select("seg_id", "ord", "x", "y", F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("lake_level", "own", "surface", "z", F.lit(0.0)).alias("level")), "network")
    last = traced.vertices.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n"))
    joints = river_ops.junctions(traced.spans, last).join(vertices.select("seg_id", "ord", "x", "y", "z"), ["seg_id", "ord"])
    hashes = measures.geometry_hash(traced.vertices.select("seg_id", "ord", "x", "y")).select("seg_id", F.col("hash").alias("geom_hash"))
    out = segments.join(hashes, "seg_id")
    if labels is not None:
        nodes = walks.end_nodes(traced.vertices.select("seg_id", "ord", "row", "col"), labels.select("row", "col", "label")).select("seg_id", F.col("node").cast("long").alias("node_id"))
        out = out.join(nodes, "seg_id")
    else:
        out = out.withColumn("node_id", F.lit(None).cast("long"))
    return written(out, "segments"), vertices, written(joints.select("seg_id", "ord", "kind", "lake_id", "x", "y", "z"), "junctions")


def reports(traced: Traced, vertices: DataFrame) -> dict:
    """What the network's own checks count: descent, direction, connectivity."""
    wet = vertices.join(traced.vertices.select("seg_id", "ord", "lake_id"), ["seg_id", "ord"]).select("seg_id", "ord", "z", "lake_id")
    return {"descent": river_ops.descent_report(wet).first().asDict(), "direction": river_ops.flow_direction_report(wet).first().asDict(), "connectivity": river_ops.connectivity(traced.segments).first().asDict()}
