"""Which samples of a mapped lake are water, low ground, dry land and islands, by the scan of its edge strip."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tarn.operators.graph import components
from tarn.operators.spatial import edge_of, grid_components
from tarn.operators.tiles import Tile, dealt
from tarn.runtime import written


@dataclass(frozen=True)
class ShoreRules:
    plane_m: float = 0.15
    edge_drop_m: float = 0.3
    inset: int = 2
    scraps: int = 10
    flat_m: float = 0.05
    band_m: float = 15.0
    island_m: float = 1.0


def _scan(cells: DataFrame, spacing_m: float, rules: ShoreRules) -> DataFrame:
    """``row, col, lake_id, h, inner, calm, near, outer`` of lake samples with a height, by what lies around each, in tiles.

    ``inner``: all within ``inset`` rows and columns are samples of the lake; ``calm``: it is flat there, or as high as a flat neighbour; ``near``: within ``band_m`` of
    a sample that isn't of the lake; ``outer``: not all neighbours are samples of the lake.
    """
    radius = rules.band_m / spacing_m
    halo = max(rules.inset, int(radius), 2)
    square = lambda n: [(r, c) for r in range(-n, n + 1) for c in range(-n, n + 1)]
    given = cells.select("row", "col", "lake_id", F.col("h").cast("double").alias("h"))
    kinds = {c: given.schema[c].dataType for c in given.columns} | dict.fromkeys(("inner", "calm", "near", "outer"), BooleanType())

    def run(table: pa.Table) -> pa.Table:
        tile = Tile(table, halo)
        high = tile.table["h"].combine_chunks()
        have, h = np.asarray(pc.is_valid(high)), high.to_numpy(zero_copy_only=False)
        lake = tile.codes("lake_id")
        known = np.asarray(pc.fill_null(pc.greater(tile.table["lake_id"].combine_chunks(), 0), False))
        wet = have & known
        inner, outer, near, rise, fall = wet.copy(), ~wet, np.zeros(len(h), bool), h.copy(), h.copy()
        for r, c in square(rules.inset):
            at = tile.beside(r, c)
            inner &= (at >= 0) & wet[at] & (lake[at] == lake)
        for r, c in square(1):
            at = tile.beside(r, c)
            outer |= ~((at >= 0) & wet[at] & (lake[at] == lake))
            there = (at >= 0) & have[at] & have
            rise[there], fall[there] = np.maximum(rise[there], h[at[there]]), np.minimum(fall[there], h[at[there]])
        flat = have & (rise - fall <= rules.flat_m)
        calm = flat.copy()
        for r, c in square(1):
            at = tile.beside(r, c)
            calm |= have & (at >= 0) & flat[at] & (np.abs(h - h[at]) <= rules.plane_m)
        for r, c in square(int(radius)):
            if r * r + c * c <= radius * radius:
                at = tile.beside(r, c)
                near |= (at >= 0) & (lake[at] >= 0) & (lake[at] != lake)
        out = tile.table.select(["row", "col", "lake_id", "h"])
        for name, flags in (("inner", inner), ("calm", calm), ("near", near), ("outer", outer)):
            out = out.append_column(name, pa.array(flags))
        return out.filter(pa.array(tile.own & wet))

    return dealt(given, halo).applyInArrow(run, StructType([StructField(n, t) for n, t in kinds.items()]))


def split_shores(cells: DataFrame, levels: DataFrame, sy: int, sx: int, spacing_m: float, rules: ShoreRules = ShoreRules()) -> DataFrame:
    """``row, col, lake_id, part, anchor`` of lake samples whose lake has a level: ``part`` is plane, ground, land or island.

    Plane is what lies at the water's height as scanned (the median of samples ``inset`` inside), flat, beside flat at the same height, or
    farther in than the strip. Of the rest, what is under the level is ground; what is over it is land if it is joined to the outside through
    land, an island if it rises ``island_m`` over the level anywhere, else plane. Scraps of plane below the level, beside a larger piece, are ground. The strip is counted from
    whatever isn't the same lake, another lake too. ``anchor`` is where the
    bed may begin. Cells: ``row, col, h, lake_id`` (0: none).
    """
    # Left joins, as of an inner one either side may be broadcast, and the lattice is small as a file.
    wet = written(_scan(cells, spacing_m, rules).join(levels.where("level is not null").select("lake_id", "level"), "lake_id", "left"), "wet").where("level is not null")
    deep = wet.where("inner").groupBy("lake_id").agg(F.count(F.lit(1)).alias("n"), F.median("h").alias("mid")).where("n >= 10").select("lake_id", "mid")
    plane_at = wet.groupBy("lake_id").agg(F.median("h").alias("all")).join(deep, "lake_id", "left").select("lake_id", F.coalesce("mid", "all").alias("pz"))
    calm = (F.abs(F.col("h") - F.col("pz")) <= rules.plane_m) | F.col("calm")
    rows = written(wet.join(plane_at, "lake_id", "left").select("row", "col", "lake_id", "h", "level", "pz", calm.alias("calm"), "near", "outer"), "strip")
    held = ("lake_id", "h", "level", "pz", "near", "outer")
    pieces = written(grid_components(rows.where("calm"), sx, "lake_id", diagonal=True, keep=held), "pieces")
    sizes = pieces.where("pz < level").groupBy("lake_id", "comp").agg(F.count(F.lit(1)).alias("n"))
    # A lake's only piece of plane is its water, however small.
    several = sizes.groupBy("lake_id").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1").select("lake_id")
    small = sizes.where(F.col("n") < rules.scraps).join(several, "lake_id", "left_semi").select("comp", F.lit(True).alias("scrap"))
    plane = pieces.join(small.hint("merge"), "comp", "left").select("row", "col", *held, F.coalesce("scrap", F.lit(False)).alias("scrap"), F.lit(True).alias("calm"))
    rows = plane.unionByName(rows.where("not calm").select("row", "col", *held, F.lit(False).alias("scrap"), F.lit(False).alias("calm")))
    first = F.when(~F.col("near") | (F.col("calm") & ~F.col("scrap")), "plane").when(F.col("h") < F.col("level"), "ground").otherwise("land")
    rows = written(rows.withColumn("part", first).withColumn("anchor", F.least(F.col("pz"), F.col("level") - rules.edge_drop_m)), "parts")
    land = rows.where("part = 'land'").select("row", "col", "lake_id", "anchor", "outer", (F.col("h") - F.col("level")).alias("over"))
    land = written(grid_components(land, sx, "lake_id", diagonal=True, keep=("lake_id", "anchor", "outer", "over")), "land")
    # Joined to the outside: next to a cell of another lake or none, or at the edge of the map.
    kinds = land.groupBy("comp").agg(F.max("outer").alias("outside"), F.max("over").alias("peak"))
    kind = F.when(F.col("outside"), "land").when(F.col("peak") >= rules.island_m, "island").otherwise("plane")
    final = land.join(kinds.hint("merge"), "comp").select("row", "col", "lake_id", kind.alias("part"), "anchor")
    return rows.where("part != 'land'").select("row", "col", "lake_id", "part", "anchor").union(final)


def low_ground(cells: DataFrame, levels: DataFrame, sy: int, sx: int, spacing_m: float, *, most_m: float = 50.0) -> DataFrame:
    """``row, col, lake_id``: land outside a lake's outline that lies below its level and belongs to it: patches that touch the lake, are enclosed within ``most_m`` of it, don't reach the map's edge, and aren't larger than the lake.

    Every lake looks at the land around its border; a patch that goes on farther has members in the outermost ring of what is looked at, and so is open. A sample that
    several lakes claim goes to the first. Cells: ``row, col, h, kind, lake_id`` and perhaps ``island``.
    """
    if "island" not in cells.columns:
        cells = cells.withColumn("island", F.lit(False))
    wet = cells.where("kind = 2").join(levels.where("level is not null"), "lake_id").select("row", "col", "lake_id", "level")
    border = edge_of(cells.select("row", "col", F.when(F.col("kind") == 2, F.col("lake_id")).otherwise(0).alias("lake_id")), "lake_id").where("lake_id > 0").join(levels.where("level is not null").select("lake_id", "level"), "lake_id")
    n = math.ceil(most_m / spacing_m) + 2
    steps = [(r, c) for r in range(-n, n + 1) for c in range(-n, n + 1) if r * r + c * c <= n * n]
    way = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(math.hypot(r, c)).alias("d")) for r, c in steps)))
    sent = border.withColumn("w", way).select((F.col("row") - F.col("w.r")).alias("row"), (F.col("col") - F.col("w.c")).alias("col"), F.col("lake_id").alias("lake"), "level", "w.d").groupBy("row", "col", "lake").agg(F.min("d").alias("d"), F.max("level").alias("level"))
    low = written(cells.where("kind = 0 and not island and h is not null").select("row", "col", "h").join(sent, ["row", "col"]).where("h < level").select("row", "col", "lake", "d", F.struct("lake", "row", "col").alias("node")), "low")
    ahead = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, 0), (1, 1), (1, -1)))))
    pairs = low.withColumn("w", ahead).select("lake", (F.col("row") + F.col("w.r")).alias("row"), (F.col("col") + F.col("w.c")).alias("col"), F.col("node").alias("a")).join(low.select("lake", "row", "col", F.col("node").alias("b")), ["lake", "row", "col"]).select("a", "b")
    patch = written(low.join(components(pairs), "node", "left").select("row", "col", "lake", "d", F.coalesce("comp", "node").alias("comp")), "patches")
    edge = F.col("row").isin(0, sy - 1) | F.col("col").isin(0, sx - 1)
    sizes = wet.groupBy(F.col("lake_id").alias("lake")).agg(F.count(F.lit(1)).alias("own"))
    facts = patch.groupBy("lake", "comp").agg(F.min("d").alias("near"), F.max("d").alias("far"), F.max(edge.cast("int")).alias("edge"), F.count(F.lit(1)).alias("n")).join(sizes, "lake")
    good = facts.where((F.col("near") < 1.5) & (F.col("far") * spacing_m <= most_m) & (F.col("edge") == 0) & (F.col("n") <= F.col("own")))
    return patch.join(good.select("lake", "comp"), ["lake", "comp"], "left_semi").groupBy("row", "col").agg(F.min("lake").alias("lake_id"))
