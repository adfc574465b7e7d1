"""Side channels: pieces of mapped water that no line is drawn through, and the cheapest line along each from its river on.

A piece is worked on in a raster of its own, about as fine as a metre, so a task holds one piece. What a line is for (which lake it runs into,
where it comes back) is decided in tables beforehand.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.lakebeds import nearest
from tarn.operators.spatial import grid_components
from tarn.runtime import written


@dataclass(frozen=True)
class BranchRules:
    """What is large, wide and long enough, how contacts are told apart, how far lines run on."""

    area_m2: float = 1500.0
    contact_m: float = 6.0
    length_m: float = 40.0
    width_m: float = 4.0
    split_m: float = 20.0
    overrun_m: float = 15.0
    smooth: int = 15
    corridor_cost: float = 4.0


def undrawn_pieces(area: DataFrame, drawn: DataFrame, lakes: DataFrame, samples_x: int, spacing_m: float, rules: BranchRules = BranchRules()) -> DataFrame:
    """``row, col, piece`` of mapped river area (``row, col``) that no line covers (``drawn``) and that is in no lake: 8-connected pieces of at least ``area_m2``, named by their first cell."""
    left = area.select("row", "col").join(drawn.select("row", "col"), ["row", "col"], "left_anti").join(lakes.select("row", "col"), ["row", "col"], "left_anti")
    comp = written(grid_components(left, samples_x, diagonal=True), "pieces")
    large = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * spacing_m**2 >= rules.area_m2)
    return comp.join(large, "comp", "left_semi").select("row", "col", F.col("comp").alias("piece"))


def contacts(pieces: DataFrame, vertices: DataFrame, spacing_m: float, rules: BranchRules = BranchRules()) -> DataFrame:
    """``piece, seg_id, ord, position, sink, gap``: river vertices outside lakes that come within their half width and ``contact_m`` of a piece.

    Vertices: ``seg_id, ord, row, col`` (fractional)``, half_width, position, sink, wet``. Pieces send their border cells to the squares of a grid that their reach touches.
    """
    most = vertices.agg(F.max("half_width")).first()[0] or 0.0
    reach = (most + rules.contact_m) / spacing_m + 1
    size = max(reach, 1.0)
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    spread = pieces.select("piece", F.col("row").alias("pr"), F.col("col").alias("pc")).withColumn("w", around).select("piece", "pr", "pc", (F.floor(F.col("pr") / size) + F.col("w.a")).alias("br"), (F.floor(F.col("pc") / size) + F.col("w.b")).alias("bc"))
    placed = vertices.where(~F.col("wet")).withColumn("br", F.floor(F.col("row") / size)).withColumn("bc", F.floor(F.col("col") / size))
    far = F.sqrt((F.col("row") - F.col("pr")) ** 2 + (F.col("col") - F.col("pc")) ** 2) * spacing_m
    met = placed.join(spread, ["br", "bc"]).withColumn("gap", far).groupBy("piece", "seg_id", "ord", "position", "sink", "half_width").agg(F.min("gap").alias("gap"))
    return met.where(F.col("gap") <= F.col("half_width") + rules.contact_m + spacing_m).select("piece", "seg_id", "ord", "position", "sink", "gap")


def ends(touches: DataFrame, below: DataFrame, beside: DataFrame, rules: BranchRules = BranchRules()) -> DataFrame:
    """``piece, seg_id, ord, lake_id, rejoin_id, rejoin_ord, why``: where a piece's channel leaves its river and what it runs into, or why it has none.

    It leaves at the contact farthest from the sea. It runs into a lake that the piece touches (``beside``: ``piece, lake_id, cells``) and that the river reaches from there
    (``below``: ``piece, lake_id``); else it comes back at the farthest contact down the same river, ``length_m`` on at least, if there are two apart by ``split_m``.
    """
    top = touches.groupBy("piece").agg(F.max(F.struct("position", "sink", "seg_id", "ord")).alias("t"))
    same = touches.join(top, "piece").where(F.col("sink") == F.col("t.sink"))
    order = Window.partitionBy("piece").orderBy(F.desc("position"), "seg_id", "ord")
    gaps = same.withColumn("apart", (F.lag("position").over(order) - F.col("position") > rules.split_m).cast("int"))
    facts = gaps.groupBy("piece").agg((F.coalesce(F.sum("apart"), F.lit(0)) + 1).alias("clusters"), F.min(F.struct("position", "seg_id", "ord")).alias("low"))
    lakes = beside.join(below, ["piece", "lake_id"], "left_semi").groupBy("piece").agg(F.max(F.struct("cells", (-F.col("lake_id")).alias("minus"))).alias("l")).select("piece", (-F.col("l.minus")).alias("lake_id"))
    other = beside.select("piece").distinct().withColumn("other", F.lit(True))
    rows = top.join(facts, "piece").join(lakes, "piece", "left").join(other, "piece", "left")
    back = F.col("lake_id").isNull() & (F.col("clusters") >= 2) & (F.col("t.position") - F.col("low.position") >= rules.length_m)
    why = F.when(F.col("lake_id").isNull() & ~back, F.when(F.col("other"), "lake_upstream").otherwise("one_contact"))
    return rows.select("piece", "t.seg_id", "t.ord", "lake_id", F.when(back, F.col("low.seg_id")).alias("rejoin_id"), F.when(back, F.col("low.ord")).alias("rejoin_ord"), why.alias("why"))


def cheapest_path(cost: np.ndarray, start: tuple[int, int], target: np.ndarray) -> np.ndarray:
    """(row, column) of the cheapest 8-connected way from ``start`` to the first of ``target``: a step costs its length times the mean of both cells; infinite cells are closed. Empty where there is none."""
    best = np.full(cost.shape, np.inf)
    came: dict[tuple[int, int], tuple[int, int]] = {}
    best[start] = 0.0
    queue = [(0.0, start)]
    while queue:
        d, at = heapq.heappop(queue)
        if d > best[at]:
            continue
        if target[at]:
            way = [at]
            while way[-1] in came:
                way.append(came[way[-1]])
            return np.array(way[::-1])
        r, c = at
        for rr in range(max(r - 1, 0), min(r + 2, cost.shape[0])):
            for cc in range(max(c - 1, 0), min(c + 2, cost.shape[1])):
                step = d + np.hypot(rr - r, cc - c) * (cost[r, c] + cost[rr, cc]) / 2
                if (rr, cc) != at and step < best[rr, cc]:
                    best[rr, cc], came[rr, cc] = step, at
                    heapq.heappush(queue, (step, (rr, cc)))
    return np.zeros((0, 2), int)


def corridor(cost: np.ndarray, mask: np.ndarray, at: tuple[int, int], price: float) -> None:
    """Open a straight way, three cells wide, from ``at`` to the nearest cell of ``mask``, where the cost is closed."""
    _, r, c = nearest(mask)
    to = r[at], c[at]
    n = max(abs(to[0] - at[0]), abs(to[1] - at[1])) + 1
    for a, b in np.rint(np.linspace(at, to, n)).astype(int):
        part = cost[max(a - 1, 0) : a + 2, max(b - 1, 0) : b + 2]
        part[~np.isfinite(part)] = price


def channel(piece: np.ndarray, lake: np.ndarray, start: tuple[int, int], back: tuple[int, int] | None, res: float, rules: BranchRules = BranchRules()) -> tuple[np.ndarray, np.ndarray] | None:
    """A channel through a piece: (row, column) places along its middle and the full width at each; None where it doesn't run through the piece. It ends at ``back``, or at the first cell of ``lake``."""
    inside, _, _ = nearest(~np.pad(piece, 1))
    depth = inside[1:-1, 1:-1] * res * piece
    cost = np.where(piece | lake, 1 / (depth + 0.5) ** 2, np.inf)
    corridor(cost, piece, start, rules.corridor_cost)
    target = lake.copy()
    if back is not None:
        corridor(cost, piece, back, rules.corridor_cost)
        target[:] = False
        target[back] = True
    way = cheapest_path(cost, start, target)
    if len(way) < 2 or piece[way[:, 0], way[:, 1]].mean() < 0.5:
        return None
    wide = 2 * depth[way[:, 0], way[:, 1]]
    known = np.flatnonzero(wide > 0)
    wide = np.interp(np.arange(len(wide)), known, wide[known])
    side = max(1, rules.smooth // 2)
    even = lambda v: np.convolve(np.pad(v, side, mode="edge"), np.ones(2 * side + 1) / (2 * side + 1), mode="valid")
    line = np.stack([even(way[:, k].astype(float)) for k in (0, 1)], 1)
    line[0], line[-1] = way[0], way[-1]
    wide = np.maximum(even(wide), np.median(wide) / 2)
    if back is None:  # on into the lake, so that the channel has a span there
        way_on = line[-1] - line[max(0, len(line) - 8)]
        size = np.hypot(*way_on)
        if size > 0:
            line, wide = np.vstack([line, line[-1] + way_on / size * rules.overrun_m / res]), np.append(wide, wide[-1])
    length = np.hypot(*np.diff(line, axis=0).T).sum() * res
    return (line, wide) if length >= rules.length_m and np.median(wide) >= rules.width_m else None


def channels(pieces: DataFrame, plan: DataFrame, lakes: DataFrame, spacing_m: float, rules: BranchRules = BranchRules()) -> DataFrame:
    """``piece, ord, row, col, width`` of the channels that can be drawn, in cells and metres.

    Plan: ``piece, row, col`` (where it leaves the river)``, lake_id`` or ``back_row, back_col``. Lake cells (``row, col, lake_id``) beside the piece belong to its raster.
    """

    def run(table: pa.Table) -> pa.Table:
        pdf = table.to_pandas()
        first = pdf.iloc[0]
        marks = [(first["at_row"], first["at_col"])] + ([] if np.isnan(first["back_row"]) else [(first["back_row"], first["back_col"])])
        rows, cols = [*pdf["row"], *(m[0] for m in marks)], [*pdf["col"], *(m[1] for m in marks)]
        r0, c0 = int(np.floor(min(rows))) - 2, int(np.floor(min(cols))) - 2
        shape = (int(np.ceil(max(rows))) - r0 + 3, int(np.ceil(max(cols))) - c0 + 3)
        own, lake = np.zeros(shape, bool), np.zeros(shape, bool)
        is_lake = pdf["is_lake"].to_numpy(bool)
        r, c = pdf["row"].to_numpy(int) - r0, pdf["col"].to_numpy(int) - c0
        own[r[~is_lake], c[~is_lake]] = True
        lake[r[is_lake], c[is_lake]] = True
        places = [(int(round(a)) - r0, int(round(b)) - c0) for a, b in marks]
        made = channel(own, lake, places[0], places[1] if len(places) > 1 else None, spacing_m, rules)
        line, wide = made if made else (np.zeros((0, 2)), np.zeros(0))
        n = len(line)
        columns = [np.full(n, int(first["piece"])), np.arange(n), line[:, 0] + r0, line[:, 1] + c0, wide]
        return pa.table([pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["piece", "ord", "row", "col", "width"])

    facts = plan.select("piece", F.col("row").cast("double").alias("at_row"), F.col("col").cast("double").alias("at_col"), "lake_id", F.col("back_row").cast("double").alias("back_row"), F.col("back_col").cast("double").alias("back_col"))
    own = pieces.select("piece", "row", "col").withColumn("is_lake", F.lit(False))
    ring = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-3, 4) for b in range(-3, 4))))
    near = pieces.withColumn("w", ring).select("piece", (F.col("row") + F.col("w.a")).alias("row"), (F.col("col") + F.col("w.b")).alias("col")).distinct()
    wet = near.join(lakes.select("row", "col", "lake_id"), ["row", "col"]).join(facts.select("piece", "lake_id"), ["piece", "lake_id"], "left_semi").select("piece", "row", "col").withColumn("is_lake", F.lit(True))
    rows = own.unionByName(wet).join(facts.drop("lake_id"), "piece")
    return rows.groupBy("piece").applyInArrow(run, "piece long, ord int, row double, col double, width double")


def side_channels(area: DataFrame, drawn: DataFrame, lakes: DataFrame, vertices: DataFrame, below: DataFrame, samples_x: int, spacing_m: float, rules: BranchRules = BranchRules()) -> tuple[DataFrame, DataFrame]:
    """Channels (``piece, ord, row, col, width``) through the undrawn pieces of mapped water, and what was decided for each piece (as ``ends`` says).

    Vertices as in ``contacts``; ``below``: ``seg_id, ord, lake_id``, the lakes that a vertex's water reaches.
    """
    pieces = written(undrawn_pieces(area, drawn, lakes, samples_x, spacing_m, rules), "undrawn")
    touches = written(contacts(pieces, vertices, spacing_m, rules), "contacts")
    ring = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    beside = pieces.withColumn("w", ring).select("piece", (F.col("row") + F.col("w.a")).alias("row"), (F.col("col") + F.col("w.b")).alias("col")).distinct().join(lakes.select("row", "col", "lake_id"), ["row", "col"]).groupBy("piece", "lake_id").agg(F.count(F.lit(1)).alias("cells"))
    top = touches.groupBy("piece").agg(F.max(F.struct("position", "sink", "seg_id", "ord")).alias("t")).select("piece", "t.seg_id", "t.ord")
    reached = top.join(below, ["seg_id", "ord"]).select("piece", "lake_id")
    made = written(ends(touches, reached, beside, rules), "ends")
    at = vertices.select("seg_id", "ord", "row", "col")
    back = at.select(F.col("seg_id").alias("rejoin_id"), F.col("ord").alias("rejoin_ord"), F.col("row").alias("back_row"), F.col("col").alias("back_col"))
    plan = made.where("why is null").join(at, ["seg_id", "ord"]).join(back, ["rejoin_id", "rejoin_ord"], "left")
    return channels(pieces, plan, lakes, spacing_m, rules), made
