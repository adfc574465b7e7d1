"""Following water: where on its way to the sea a line is, what lies below it, and walks down the heights that rivers should be able to make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators import graph
from tarn.operators.geometry import arc_lengths
from tarn.runtime import written

#: Row and column steps of the flow codes 1 to 8, clockwise from north; fixed values.
STEPS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def downstream_positions(segments: DataFrame) -> DataFrame:
    """``seg_id, below, sink``: the metres of all lines below a line's end, and the last of them. Segments: ``seg_id, downstream, length``; a downstream that isn't there is none.

    Sums double their reach each round. Lines of a cycle, and those that run into one, have no sink and come back with nulls.
    """
    there = segments.select(F.col("seg_id").alias("downstream"), F.col("length").alias("more"))
    linked = segments.select("seg_id", "downstream").join(there, "downstream", "left")
    now = written(linked.select("seg_id", F.when(F.col("more").isNotNull(), F.col("downstream")).alias("to"), F.coalesce("more", F.lit(0.0)).cast("double").alias("below"), F.when(F.col("more").isNotNull(), F.col("downstream")).otherwise(F.col("seg_id")).alias("sink")), "positions")
    reach, many = 1, now.count()
    while reach <= many and not now.where("to is not null").isEmpty():
        ahead = now.select(F.col("seg_id").alias("to"), F.col("to").alias("then"), F.col("below").alias("further"), F.col("sink").alias("last"))
        both = now.join(ahead, "to", "left")
        now = written(both.select("seg_id", F.col("then").alias("to"), (F.col("below") + F.coalesce("further", F.lit(0.0))).alias("below"), F.coalesce("last", "sink").alias("sink")), "positions")
        reach *= 2
    ended = F.col("to").isNull()
    return now.select("seg_id", F.when(ended, F.col("below")).alias("below"), F.when(ended, F.col("sink")).alias("sink"))


def vertex_positions(vertices: DataFrame, positions: DataFrame) -> DataFrame:
    """``seg_id, ord, position, sink``: the metres from each vertex to its network's end."""
    arcs = arc_lengths(vertices)
    total = F.max("arc").over(Window.partitionBy("seg_id"))
    return arcs.withColumn("left", total - F.col("arc")).join(positions.where("sink is not null"), "seg_id").select("seg_id", "ord", (F.col("left") + F.col("below")).alias("position"), "sink")


def lines_below(starts: DataFrame, segments: DataFrame, metres: float) -> DataFrame:
    """``id, seg_id, begins``: the lines that lie within ``metres`` downstream of a place, and how far from it each begins (0 for its own line).

    Starts: ``id, seg_id, left`` (metres from the place to its line's end); segments: ``seg_id, downstream, length``. The frontier goes on
    a line a round, and only as long as it is within reach.
    """
    known = written(segments.select("seg_id", "downstream", F.col("length").cast("double").alias("length")), "links")
    front = written(starts.select("id", "seg_id", F.lit(0.0).alias("begins"), F.col("left").cast("double").alias("ends")), "front")
    found = front.select("id", "seg_id", "begins")
    while True:
        on = front.where(F.col("ends") < metres).join(known.select("seg_id", "downstream"), "seg_id").where("downstream is not null")
        ahead = on.select("id", F.col("downstream").alias("seg_id"), F.col("ends").alias("begins")).join(known.select("seg_id", "length"), "seg_id")
        # A line that was met before closes a cycle.
        fresh = ahead.join(found.select("id", "seg_id"), ["id", "seg_id"], "left_anti")
        front = written(fresh.select("id", "seg_id", "begins", (F.col("begins") + F.col("length")).alias("ends")), "front")
        if front.isEmpty():
            return found
        found = found.union(front.select("id", "seg_id", "begins"))


def lakes_below(starts: DataFrame, segments: DataFrame, spans: DataFrame, metres: float = 3000.0) -> DataFrame:
    """``id, lake_id``: lakes that a place's water meets within ``metres``. Spans: ``seg_id, lake_id, enters`` and ``leaves``, in metres from the line's begin; starts also have ``at``, the place's own metres from there."""
    chain = lines_below(starts, segments, metres).join(starts.select("id", "at", F.col("seg_id").alias("own")), "id")
    met = chain.join(spans, "seg_id")
    first = F.col("seg_id") == F.col("own")
    far = F.when(first, F.greatest(F.col("enters") - F.col("at"), F.lit(0.0))).otherwise(F.col("begins") + F.col("enters"))
    passed = first & (F.col("leaves") < F.col("at"))
    return met.where(~passed & (far <= metres)).select("id", "lake_id").distinct()


def carriers(vertices: DataFrame, share: float = 0.5, metres: float = 200.0) -> DataFrame:
    """``seg_id, inside, inside_m``: the lines with half their vertices or 200 metres of their length in an area. Vertices: ``seg_id, ord, x, y, inside``."""
    along = Window.partitionBy("seg_id").orderBy("ord")
    dx, dy = F.col("x") - F.lag("x").over(along), F.col("y") - F.lag("y").over(along)
    both = F.col("inside") & F.lag("inside").over(along)
    rows = vertices.withColumn("step", F.when(both, F.sqrt(dx * dx + dy * dy)).otherwise(0.0))
    sums = rows.groupBy("seg_id").agg(F.avg(F.col("inside").cast("double")).alias("inside"), F.sum("step").alias("inside_m"))
    return sums.where((F.col("inside") > 0) & ((F.col("inside") >= share) | (F.col("inside_m") >= metres)))


def wet_vertices(vertices: DataFrame, spans: DataFrame) -> DataFrame:
    """``vertices`` with ``wet``, whether they lie in a lake span (``seg_id, a, b``)."""
    runs = spans.groupBy("seg_id").agg(F.collect_list(F.struct("a", "b")).alias("__runs"))
    inside = F.exists(F.coalesce("__runs", F.expr("cast(array() as array<struct<a:int,b:int>>)")), lambda s: F.col("ord").between(s["a"], s["b"]))
    return vertices.join(runs.withColumn("__runs", F.transform("__runs", lambda s: F.struct(s["a"].cast("int").alias("a"), s["b"].cast("int").alias("b")))), "seg_id", "left").withColumn("wet", inside).drop("__runs")


def half_widths(vertices: DataFrame) -> DataFrame:
    """``vertices`` with ``half_width``: half the vertex's own ``vertex_width``, or half its line's ``width``, or half a metre."""
    return vertices.withColumn("half_width", F.coalesce("vertex_width", "width", F.lit(1.0)) / 2)


def _next_cell(flow: Column) -> tuple[Column, Column]:
    place = lambda k: F.get(F.array(*(F.lit(s[k]) for s in STEPS)), flow - 1)
    return F.col("row") + place(0), F.col("col") + place(1)


def drainage_counts(flow: DataFrame, sx: int) -> DataFrame:
    """``cell, samples``: how many samples drain to each cell that water stops at, itself among them. Flow: ``row, col, flow`` (1 to 8; 0 or null: it stops)."""
    to_row, to_col = _next_cell(F.col("flow"))
    at = lambda r, c: (r.cast("long") * sx + c).cast("long")
    pointers = flow.select(at(F.col("row"), F.col("col")).alias("node"), F.when((F.col("flow") > 0) & to_col.between(0, sx - 1), at(to_row, to_col)).alias("next"))
    there = pointers.select(F.col("node").alias("next"))
    inside = pointers.join(there.withColumn("in", F.lit(True)), "next", "left").select("node", F.when(F.col("in"), F.col("next")).alias("next"))
    ends = graph.jump(inside)
    return ends.where("next is not null").groupBy(F.col("next").alias("cell")).agg(F.count(F.lit(1)).alias("samples"))


#: How a walk ends; fixed values.
OK, LEFT_CORRIDOR, PIT, STALLED = 0, 1, 2, 3
#: Steps that are joined in one round of walks.
HOPS = 16


def river_walks(starts: DataFrame, cells: DataFrame, sx: int) -> DataFrame:
    """``seg_id, status, cell, steps``: where a walk down the heights from a river's beginning ends, and how.

    Starts: ``seg_id, cell, end_cell, most`` (steps). Cells: ``cell, row, col, flow`` (flats resolved; null or 0: none)``, stop`` (lake or map edge)``, corridor, pit``.
    A walk is well where it comes beside the river's end, to a lake or an edge, or has made all its steps. Else it has left the rivers' corridor, or is in a pit, or on
    a flat without a way out. ``HOPS`` steps are one round, and only walks that go on take part.
    """
    to_row, to_col = _next_cell(F.col("flow"))
    moves = written(cells.select("cell", "row", "col", "stop", "corridor", "pit", F.when((F.col("flow") > 0) & to_col.between(0, sx - 1), to_row.cast("long") * sx + to_col).alias("to")), "moves")
    front = written(starts.select("seg_id", "cell", "end_cell", "most", F.lit(0).alias("steps")), "walks")
    done = None
    while True:
        now = front.withColumn("status", F.lit(None).cast("int"))
        for _ in range(HOPS):
            at = now.join(moves, "cell", "left")
            er, ec = F.floor(F.col("end_cell") / sx), F.col("end_cell") % sx
            near = (F.abs(F.col("row") - er) <= 1) & (F.abs(F.col("col") - ec) <= 1)
            ended = F.when(near | F.col("stop") | (F.col("steps") >= F.col("most")), OK).when(~F.col("corridor"), LEFT_CORRIDOR).when(F.col("to").isNull(), F.when(F.col("pit"), PIT).otherwise(STALLED))
            state = F.coalesce("status", F.when(F.col("row").isNull(), F.lit(STALLED)).otherwise(ended))
            moved = state.isNull()
            now = at.select("seg_id", F.when(moved, F.col("to")).otherwise(F.col("cell")).alias("cell"), "end_cell", "most", (F.col("steps") + moved.cast("int")).alias("steps"), state.alias("status"))
        now = written(now, "walks")
        some = now.where("status is not null").select("seg_id", "status", "cell", "steps")
        done = some if done is None else done.union(some)
        front = now.where("status is null").drop("status")
        if front.isEmpty():
            return done


def walk_findings(walks: DataFrame, nodes: DataFrame, labels: DataFrame, least_m: float = 0.5) -> DataFrame:
    """``seg_id, status, cell, node, depth``: walks that didn't end well; of pits only those ``least_m`` deep. Labels: ``cell, label``; nodes: ``node, floor_m, spill_m``."""
    bad = walks.where(F.col("status") != OK).join(labels, "cell", "left")
    deep = bad.join(nodes.select(F.col("node").alias("label"), (F.col("spill_m") - F.col("floor_m")).alias("depth")), "label", "left")
    pit = F.col("status") == PIT
    return deep.where(~pit | (F.col("depth") >= least_m)).select("seg_id", "status", "cell", F.when(pit, F.col("label")).alias("node"), F.when(pit, F.round("depth", 3)).alias("depth"))


def spill_kinds(saddles: DataFrame, cells: DataFrame, sy: int, sx: int) -> DataFrame:
    """``node, kind``: what a node spills through, by its two saddle samples: ``map_edge``, then ``river_channel``, then ``other_lake``, else ``land``.

    Saddles: ``node, spill_cell, outlet_cell, own_lake``; cells: ``cell, kind, lake_id``.
    """
    ends = saddles.select("node", "own_lake", F.explode(F.array("spill_cell", "outlet_cell")).alias("cell")).join(cells.select("cell", "kind", "lake_id"), "cell", "left")
    row, col = F.floor(F.col("cell") / sx), F.col("cell") % sx
    rank = F.when(row.isin(0, sy - 1) | col.isin(0, sx - 1), 3).when(F.col("kind") == 1, 2).when((F.col("kind") == 2) & (F.col("lake_id") != F.col("own_lake")), 1).otherwise(0)
    names = F.array(*map(F.lit, ("land", "other_lake", "river_channel", "map_edge")))
    return ends.groupBy("node").agg(F.get(names, F.max(rank)).alias("kind"))


def end_nodes(vertices: DataFrame, labels: DataFrame) -> DataFrame:
    """``seg_id, node``: the leaf that the sample nearest to a line's last vertex belongs to; 0 off the map, null where there is no sample. Vertices: ``seg_id, ord, row, col``; labels: ``row, col, label``."""
    last = vertices.groupBy("seg_id").agg(F.max_by(F.struct("row", "col"), "ord").alias("at")).select("seg_id", "at.row", "at.col")
    return last.join(labels, ["row", "col"], "left").select("seg_id", F.col("label").alias("node"))


def channel_levels(cells: DataFrame, centre: DataFrame, radius: int, spacing_m: float, tolerance_m: float = 2.0) -> DataFrame:
    """``row, col, level`` of river samples: the ground under the nearest sample of a centreline, level across the channel.

    A sample further from any centreline than half its channel and a cell keeps its own ground, and no level is more than ``tolerance_m`` above it.
    Cells: ``row, col, h, kind, half_width``; centre: ``row, col``; ``radius`` bounds half widths in samples. Only centre samples on rivers send.
    """
    river = cells.where("kind = 1 and h is not null")
    source = centre.select("row", "col").distinct().join(river.select("row", "col", "h"), ["row", "col"])
    disc = [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]
    way = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(r * r + c * c).alias("d2")) for r, c in disc)))
    sent = source.withColumn("w", way).select((F.col("row") + F.col("w.r")).alias("row"), (F.col("col") + F.col("w.c")).alias("col"), F.struct("w.d2", F.col("row").alias("sr"), F.col("col").alias("sc"), F.col("h").alias("level")).alias("s"))
    near = sent.groupBy("row", "col").agg(F.min("s").alias("s"))
    rows = river.join(near, ["row", "col"], "left")
    close = F.coalesce(F.sqrt(F.col("s.d2")) * spacing_m <= F.col("half_width") + spacing_m, F.lit(False))
    return rows.select("row", "col", F.when(close, F.least(F.col("s.level"), F.col("h") + tolerance_m)).otherwise(F.col("h")).alias("level"))


def water_surface(cells: DataFrame, river_levels: DataFrame, lake_levels: DataFrame) -> DataFrame:
    """``row, col, surface``: the lake's level on its samples, else the river's; null on land. Lakes: ``lake_id, level, published``: the resolved level or the published one."""
    lakes = lake_levels.select("lake_id", F.coalesce("level", "published").alias("lake_level"))
    rows = cells.select("row", "col", "lake_id").join(lakes, "lake_id", "left").join(river_levels.select("row", "col", "level"), ["row", "col"], "left")
    return rows.select("row", "col", F.coalesce("lake_level", "level").alias("surface"))


def audit_summary(lakes: DataFrame, rivers: DataFrame, walked: int, joins: DataFrame) -> dict:
    """The audit's counts: lakes and findings by status, lakes above their spill by what they spill through, totals of depressions (one row ``unexplained, joins_lake``)."""
    count = lambda df, key: {r[key]: r["n"] for r in df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(key).toLocalIterator()}
    total = joins.first()
    return {
        "lakes": lakes.count(),
        "lakes_by_status": count(lakes, "status"),
        "lakes_above_spill_by_spill_through": count(lakes.where("status = 'level_above_spill'"), "spill_through"),
        "river_segments_walked": walked,
        "river_findings_by_status": count(rivers, "status"),
        "unexplained_depressions": total["unexplained"],
        "depressions_joining_a_lake": total["joins_lake"],
    }
