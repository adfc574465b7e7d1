"""Distance, nearest sources, components and rasters on the lattice. Cells have ``row, col``; absent rows are no data."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tarn.operators.graph import components
from tarn.operators.stencil import neighbours
from tarn.operators.tiles import Tile, dealt, links, rim
from tarn.runtime import written


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets within ``radius`` cells, the centre too."""
    return [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]


def edge_of(cells: DataFrame, key: str) -> DataFrame:
    """The cells with a neighbour of another ``key``, or with fewer than eight neighbours: nearest sources are always among them."""
    around = neighbours(cells, F.col(key).alias("other")).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("lo"), F.max("other").alias("hi"))
    return cells.join(around, ["row", "col"], "left").where((F.coalesce(F.col("n"), F.lit(0)) < 8) | (F.col("lo") != F.col(key)) | (F.col("hi") != F.col(key))).select(*cells.columns)


def nearest_within(targets: DataFrame, sources: DataFrame, radius: int, *values: str) -> DataFrame:
    """Each target with the ``values`` of its nearest source within ``radius`` cells, and ``d2``; of equally near ones the first by row, then column.

    Only edge cells of ``sources`` (by the first value) are sent, each to the fixed number of cells of a disc, so the work is in proportion
    to shore lines and no task sees more than the targets of its share.
    """
    way = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(r * r + c * c).alias("d2")) for r, c in disc(radius))))
    sent = edge_of(sources, values[0]).withColumn("w", way).select((F.col("row") + F.col("w.r")).alias("row"), (F.col("col") + F.col("w.c")).alias("col"), F.struct("w.d2", F.col("row").alias("sr"), F.col("col").alias("sc"), *values).alias("s"))
    best = sent.groupBy("row", "col").agg(F.min("s").alias("s"))
    return targets.join(best, ["row", "col"]).select(*(targets[c] for c in targets.columns), "s.d2", *(F.col(f"s.{v}").alias(f"near_{v}") for v in values))


def grid_components(cells: DataFrame, samples_x: int, key: str | None = None, diagonal: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``row, col, comp`` and the columns to ``keep``: connected cells (of equal ``key``), named by their first cell in raster order.

    Tiles are labelled each by itself; only components that meet over a tile's edge take rounds.
    """
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    named = cells.select("row", "col", (F.col(key) if key else F.lit(0)).alias("k"), *keep)
    kinds = {f.name: f.dataType for f in named.schema}

    def label(table: pa.Table) -> pa.Table:
        tile = Tile(table)
        first = tile.labels(tile.codes("k"), steps)
        return tile.table.select(list(kinds)).append_column("comp", pa.array(tile.row[first] * samples_x + tile.col[first]))

    own = written(dealt(named).applyInArrow(label, StructType([StructField(n, t) for n, t in kinds.items()] + [StructField("comp", LongType())])), "tiles")
    # A component of a tile has the tile's cells at most, so that no name is hot in the join.
    merged = components(links(own.where(rim()), steps)).select("node", F.col("comp").alias("whole"))
    return own.join(merged.hint("merge"), F.col("comp") == F.col("node"), "left").select("row", "col", F.coalesce("whole", "comp").alias("comp"), *keep)


def ocean_mask(cells: DataFrame, sy: int, sx: int, level: float) -> DataFrame:
    """``row, col`` of the sea: low dry cells (``h`` at most ``level``, ``water`` false) that are 4-connected to an edge of the map through such cells."""
    low = cells.where((F.col("h") <= level) & ~F.col("water")).select("row", "col")
    comp = grid_components(low, sx)
    shore = comp.where((F.col("row") == 0) | (F.col("row") == sy - 1) | (F.col("col") == 0) | (F.col("col") == sx - 1)).select("comp").distinct()
    return comp.join(shore, "comp", "left_semi").select("row", "col")


def reached(cells: DataFrame, samples_x: int) -> DataFrame:
    """``row, col`` of the cells (``row, col, seed``) that are 8-connected to one that is a ``seed``."""
    comp = grid_components(cells.select("row", "col"), samples_x, diagonal=True)
    wet = comp.join(cells.where("seed").select("row", "col"), ["row", "col"]).select("comp").distinct()
    return comp.join(wet, "comp", "left_semi").select("row", "col")


def escapes(cells: DataFrame, samples_y: int, samples_x: int) -> DataFrame:
    """``id, how`` for floods, each in a window of its own: ``map_edge`` where the cells connected to its seeds touch the map's edge, else ``unbounded`` where they touch the window's.

    Cells: ``id, row, col, seed, rim`` (on the window's edge): those of each window that lie below the level and aren't the lake's own. Floods that stay enclosed have no row.
    """
    named = cells.select("id", "row", "col", "seed", "rim", F.struct("id", "row", "col").alias("node"))
    way = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, 0), (1, 1), (1, -1)))))
    sent = named.withColumn("w", way).select("id", (F.col("row") + F.col("w.r")).alias("row"), (F.col("col") + F.col("w.c")).alias("col"), F.col("node").alias("a"))
    edges = sent.join(named.select("id", "row", "col", F.col("node").alias("b")), ["id", "row", "col"]).select("a", "b")
    comp = named.join(components(edges), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    wet = comp.where("seed").select("comp").distinct()
    edge = (F.col("row").isin(0, samples_y - 1)) | (F.col("col").isin(0, samples_x - 1))
    found = comp.join(wet, "comp", "left_semi").where("rim").groupBy("id").agg(F.max(edge.cast("int")).alias("e"))
    return found.select("id", F.when(F.col("e") == 1, "map_edge").otherwise("unbounded").alias("how"))


def touching(cells: DataFrame, key: str) -> DataFrame:
    """Distinct unordered pairs ``a < b`` of different keys of 8-adjacent cells."""
    way = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    sent = cells.withColumn("w", way).select((F.col("row") + F.col("w.r")).alias("row"), (F.col("col") + F.col("w.c")).alias("col"), F.col(key).alias("k"))
    return sent.join(cells, ["row", "col"]).where(F.col("k") != F.col(key)).select(F.least("k", key).alias("a"), F.greatest("k", key).alias("b")).distinct()


def _row_distance(g: np.ndarray) -> np.ndarray:
    """Squared distance along a row given squared distances along columns: the lower envelope of the parabolas."""
    n = len(g)
    out = np.full(n, np.inf)
    have = np.flatnonzero(np.isfinite(g))
    if not len(have):
        return out
    v, z = [have[0]], [-math.inf]
    for q in have[1:]:
        while True:
            s = ((g[q] + q * q) - (g[v[-1]] + v[-1] * v[-1])) / (2 * (q - v[-1]))
            if s > z[-1]:
                break
            v.pop()
            z.pop()
        v.append(q)
        z.append(s)
    k = np.searchsorted(np.array(z), np.arange(n), "right") - 1
    own = np.array(v)[np.maximum(k, 0)]
    return (np.arange(n) - own) ** 2 + g[own]


#: Cells that all rows of a batch are shifted by together; rows with farther sources take the envelope one by one.
SHIFTS = 256


def _row_distances(g: np.ndarray) -> np.ndarray:
    """``_row_distance`` of many rows: shifted by more and more cells together, as long as that can still come nearer."""
    out, wide = g.copy(), g.shape[1]
    for s in range(1, min(wide, SHIFTS + 1)):
        if not (out > s * s).any():
            return out
        np.minimum(out[:, s:], g[:, :-s] + s * s, out=out[:, s:])
        np.minimum(out[:, :-s], g[:, s:] + s * s, out=out[:, :-s])
    for r in np.flatnonzero((out > SHIFTS * SHIFTS).any(1)) if wide > SHIFTS + 1 else ():
        out[r] = _row_distance(g[r])
    return out


def distance(cells: DataFrame, sx: int, source: str = "source") -> DataFrame:
    """``row, col, d2``: exact squared distance in cells to the nearest cell where ``source`` is true; null if there is none.

    Distances along columns come from two windows, those along rows from a batch of rows at once. A task holds single rows and columns only.
    """
    # Both windows begin at an end of the column: one that reaches to the far end would be summed anew for each row.
    down, back = (Window.partitionBy("col").orderBy(order).rowsBetween(Window.unboundedPreceding, 0) for order in (F.asc("row"), F.desc("row")))
    at = F.when(F.col(source), F.col("row"))
    up = F.col("row") - F.last(at, ignorenulls=True).over(down)
    low = F.last(at, ignorenulls=True).over(back) - F.col("row")
    columns = cells.withColumn("g", F.least(up, low).cast("double")).select("row", "col", (F.col("g") * F.col("g")).alias("g"))

    def run(batches):
        for batch in batches:
            row, col, g = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            edges = col.offsets.to_numpy()
            places, values = col.flatten().to_numpy(), g.flatten().to_numpy(zero_copy_only=False).astype(float)
            which = np.repeat(np.arange(len(row)), np.diff(edges))
            lines = np.full((len(row), sx), np.inf)
            lines[which, places] = np.where(np.isnan(values), np.inf, values)
            d = _row_distances(lines)[which, places]
            far = ~np.isfinite(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row, np.diff(edges)).astype(np.int32)), pa.array(places.astype(np.int32)), pa.array(np.where(far, 0, d).astype(np.int64), mask=far)], ["row", "col", "d2"])

    # A row's samples are one value each, so that a batch holds many rows; sx bounds them.
    rows = columns.groupBy("row").agg(F.collect_list(F.struct("col", "g")).alias("v")).select("row", F.col("v.col").alias("col"), F.col("v.g").alias("g"))
    return rows.mapInArrow(run, "row int, col int, d2 long")


def raster_polygons(edges: DataFrame, sy: int, sx: int) -> DataFrame:
    """``id, row, col`` of the samples inside polygons, by the even-odd rule; holes are further rings of the same ``id``.

    ``edges``: ``id, x0, y0, x1, y1`` in fractional columns and rows. An edge crosses the line of samples of a row between its ends, the lower
    end counting and the upper not; a sample is inside if an odd number of crossings lie left of it, one exactly on it counting. So
    each row pairs its crossings in order and takes the samples between.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.greatest(F.ceil(low), F.lit(0)), F.least(F.ceil(high) - 1, F.lit(sy - 1))
    rows = edges.where(first <= last).withColumn("row", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    hits = rows.select("id", "row", (F.col("x0") + (F.col("row") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("x"))
    order = Window.partitionBy("id", "row").orderBy("x")
    pairs = hits.withColumn("n", F.row_number().over(order)).withColumn("to", F.lead("x").over(order)).where("n % 2 = 1 and to is not null")
    a, b = F.greatest(F.ceil("x"), F.lit(0)), F.least(F.ceil("to") - 1, F.lit(sx - 1))
    return pairs.where(a <= b).select("id", "row", F.explode(F.sequence(a.cast("int"), b.cast("int"))).alias("col")).distinct()


def raster_lines(pieces: DataFrame, sy: int, sx: int) -> DataFrame:
    """``row, col, id``: which straight piece covers each sample; of several the widest, then the highest ``order``, then ``ord``.

    ``pieces``: ``id, ord, order, width, x0, y0, x1, y1`` in cells. A piece is a rectangle with flat ends, 0.51 cells to either side at
    least; a sample is covered if its centre is in it.
    """
    w = F.greatest(F.col("width") / 2, F.lit(0.51))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length = F.sqrt(dx * dx + dy * dy)
    with_box = pieces.withColumn("half", w).withColumn("len", length).where("len > 0")
    span = lambda a, b, n: F.explode(F.sequence(F.greatest(F.floor(F.least(a, b) - F.col("half")), F.lit(0)).cast("int"), F.least(F.ceil(F.greatest(a, b) + F.col("half")), F.lit(n - 1)).cast("int")))
    boxed = with_box.where((F.greatest("x0", "x1") + F.col("half") >= 0) & (F.least("x0", "x1") - F.col("half") <= sx - 1) & (F.greatest("y0", "y1") + F.col("half") >= 0) & (F.least("y0", "y1") - F.col("half") <= sy - 1))
    cells = boxed.withColumn("row", span("y0", "y1", sy)).withColumn("col", span("x0", "x1", sx))
    along = ((F.col("col") - F.col("x0")) * dx + (F.col("row") - F.col("y0")) * dy) / F.col("len")
    across = F.abs((F.col("col") - F.col("x0")) * dy - (F.col("row") - F.col("y0")) * dx) / F.col("len")
    inside = cells.where((along >= 0) & (along <= F.col("len")) & (across <= F.col("half")))
    best = inside.groupBy("row", "col").agg(F.max(F.struct("width", "order", "ord", "id")).alias("m"))
    return best.select("row", "col", "m.id")
