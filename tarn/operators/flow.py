"""Flow directions on integer heights, flats included, and the catchments that they make.

Directions are 1 to 8 for N, NE, E, SE, S, SW, W, NW; 0 is an end: an edge of the map or the sink of a closed flat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from tarn.operators.graph import AT_ONCE, components, jump
from tarn.operators.tiles import SIDE, Places, Tile, dealt, links, rim
from tarn.runtime import written

#: Row and column steps of directions 1 to 8; fixed values.
STEPS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def _from_neighbours(cells: DataFrame, *values: str) -> DataFrame:
    """Each cell's values sent to its neighbours, with the direction ``d`` from the receiver towards it."""
    way = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("d"), F.lit(r).alias("r"), F.lit(c).alias("c")) for k, (r, c) in enumerate(STEPS))))
    return cells.withColumn("w", way).select((F.col("row") - F.col("w.r")).alias("row"), (F.col("col") - F.col("w.c")).alias("col"), "w.d", *values)


def _heights(tile: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Codes as whole numbers, and whether there is one."""
    code = tile.table["code"].combine_chunks()
    return np.asarray(pc.fill_null(code.cast(pa.int64()), 0)), np.asarray(pc.is_valid(code))


def _ends(tile: Tile, sy: int, sx: int) -> np.ndarray:
    return (tile.row == 0) | (tile.col == 0) | (tile.row == sy - 1) | (tile.col == sx - 1)


def _strict(tile: Tile, sy: int, sx: int) -> np.ndarray:
    """Flow of each row of a tile with its halo, -1 where nothing is lower; of use for own cells only."""
    code, have = _heights(tile)
    steepest, way = np.zeros(len(code), np.int64), np.full(len(code), -1, np.int64)
    for d, (r, c) in enumerate(STEPS, 1):
        at = tile.beside(r, c)
        drop = code - code[at]
        steep = np.where((at >= 0) & have & have[at] & (drop > 0), drop * drop * (2 if d % 2 else 1), 0)
        better = steep > steepest
        steepest[better], way[better] = steep[better], d
    return np.where(_ends(tile, sy, sx), 0, way)


def _schema(cells: DataFrame, **further) -> StructType:
    return StructType([StructField(c, cells.schema[c].dataType) for c in ("row", "col", "code")] + [StructField(n, t) for n, t in further.items()])


def _own(tile: Tile, **columns) -> pa.Table:
    """The own cells of a tile with columns added; negative flow is null."""
    out = pa.table({c: tile.table[c] for c in ("row", "col", "code")} | {n: pa.array(v.astype(np.int32), mask=v < 0) if n == "flow" else pa.array(v) for n, v in columns.items()})
    return out.filter(pa.array(tile.own))


def strict_directions(cells: DataFrame, sy: int, sx: int) -> DataFrame:
    """``row, col, code, flow``: the steepest way down by squared drop over squared distance, the lower direction among equals; 0 at edges, null where nothing is lower.

    A task holds a tile and the cells that border on it.
    """

    def run(table: pa.Table) -> pa.Table:
        tile = Tile(table)
        return _own(tile, flow=_strict(tile, sy, sx))

    return dealt(cells.select("row", "col", "code"), 1).applyInArrow(run, _schema(cells, flow=IntegerType()))


def _levels(tile: Tile) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first of the own cells of equal code that it is connected to, and, for those first ones, whether a cell of the halo goes on with it."""
    code, have = _heights(tile)
    key = np.where(have, code - code.min(), -1)
    first, goes_on = tile.labels(key, STEPS[2:6]), np.zeros(len(key), bool)
    for r, c in STEPS:
        at = tile.beside(r, c)
        goes_on[first[tile.own & (at >= 0) & ~tile.own[at] & have & (key == key[at])]] = True
    return first, goes_on


def _drained(cells: Tile | Places, flow: np.ndarray, first: np.ndarray, todo: np.ndarray) -> None:
    """Flats that are ``todo`` (by cell) get their flow: a closed one ends at its first cell, and steps lead outwards in the order of a queue."""
    out = np.zeros(len(flow), bool)
    out[first[todo & (flow >= 0)]] = True
    sink = np.flatnonzero(todo & (first == np.arange(len(first))) & ~out)
    flow[sink] = 0
    # d leads from the receiver to the sender; the sender reaches it by the opposite step.
    around = [cells.beside(-r, -c).astype(np.int32) for r, c in STEPS]
    # A cell's rank in its round stands for its outlet and the directions from there, which order the queue.
    front = np.flatnonzero(todo & (flow >= 0))
    while len(front):
        cell, order, way = [], [], []
        for d, beside in enumerate(around, 1):
            at = beside[front]
            ok = at >= 0
            ok[ok] = (flow[at[ok]] < 0) & (first[at[ok]] == first[front[ok]])
            cell.append(at[ok]), order.append(np.flatnonzero(ok) * 8 + (d + 3) % 8), way.append(np.full(ok.sum(), d))
        cell, order, way = (np.concatenate(x) for x in (cell, order, way))
        by = np.argsort(order)
        reached, at = np.unique(cell[by], return_index=True)
        flow[reached] = way[by][at]
        front = reached[np.argsort(at)]


#: Cells of a flat over a tile's edge that is drained in one task, and of the flats that are dealt to one; larger flats take rounds.
WHOLE, TASK = 1 << 20, 1 << 18


def _whole(table: pa.Table) -> pa.Table:
    """``row, col, code, flow`` of whole flats, named ``comp``."""
    cells = Places(table)
    flow = np.asarray(pc.fill_null(cells.table.column("flow").combine_chunks(), -1)).astype(np.int64)
    _, at, of = np.unique(cells.table.column("comp").to_numpy(), return_index=True, return_inverse=True)
    _drained(cells, flow, at[of], np.ones(len(flow), bool))
    return cells.table.select(["row", "col", "code"]).append_column("flow", pa.array(flow.astype(np.int32)))


def directions(cells: DataFrame, sy: int, sx: int) -> DataFrame:
    """``row, col, code, flow`` without nulls: cells of a flat lead to its outlets by the fewest steps; a closed flat leads to its first cell.

    Flats within a tile are done there, and those that go on over a tile's edge in a task that holds all of it. Flats of more than ``WHOLE`` cells take one
    round a step outwards from the outlets, over the cells that were reached last. Among equally near outlets the one of the lowest cell counts, then the
    directions that led from there: the text of directions grows with the round and orders the cells of a round.
    """

    def run(table: pa.Table) -> pa.Table:
        tile = Tile(table)
        flow, (first, goes_on) = _strict(tile, sy, sx), _levels(tile)
        wide = goes_on[first]
        _drained(tile, flow, first, tile.own & ~wide)
        return _own(tile, flow=flow, comp=tile.row[first] * sx + tile.col[first], wide=wide)

    done = written(dealt(cells.select("row", "col", "code"), 1).applyInArrow(run, _schema(cells, flow=IntegerType(), comp=LongType(), wide=BooleanType())), "flats")
    wide = done.where("wide").drop("wide")
    done = done.where("not wide").select("row", "col", "code", "flow")
    if wide.where("flow is null").isEmpty():
        return done.union(wide.select("row", "col", "code", "flow"))
    merged = components(links(wide.where(rim()).withColumn("k", F.col("code")), STEPS[2:6]), AT_ONCE).select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    state = written(wide.join(merged.hint("merge"), "comp", "left").withColumn("comp", F.coalesce("whole", "comp")).drop("whole"), "wide")
    sizes = state.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("flow").isNotNull().cast("int")).alias("out"))
    large = written(sizes.where(F.col("n") > WHOLE).select("comp", (F.col("out") == 0).alias("closed")), "large")
    some = not large.isEmpty()
    whole = state.join(large.hint("merge"), "comp", "left_anti") if some else state
    part = F.pmod(F.xxhash64("comp"), F.lit(state.count() // TASK + 1))
    done = done.union(whole.withColumn("part", part).groupBy("part").applyInArrow(_whole, _schema(cells, flow=IntegerType())))
    return done.union(_by_rounds(state.join(large.hint("merge"), "comp"), sx)) if some else done


def _by_rounds(flats: DataFrame, sx: int) -> DataFrame:
    """``row, col, code, flow`` of flats (``row, col, code, flow, comp, closed``) of any size, a round a step."""
    cell = F.col("row").cast("long") * sx + F.col("col")
    state = flats.select("row", "col", "code", F.when(F.col("closed") & (cell == F.col("comp")), 0).otherwise(F.col("flow")).alias("flow"), cell.alias("cell"))
    state = written(state, "rounds")
    done = state.where("flow is not null").select("row", "col", "code", "flow")
    front = state.where("flow is not null").select("row", "col", "code", F.col("cell").alias("seed"), F.lit("").alias("path"))
    rest = state.where("flow is null").select("row", "col", "code")
    while not rest.isEmpty():
        # d is the direction from the receiver to the sender; the sender reaches it by the opposite one, which orders the queue.
        sent = _from_neighbours(front, F.col("code").alias("other"), "seed", "path").join(rest.hint("merge"), ["row", "col"]).where("other = code")
        step = F.concat("path", (((F.col("d") + 3) % 8) + 1).cast("string"))
        got = sent.groupBy("row", "col", "code").agg(F.min(F.struct("seed", step.alias("path"), F.col("d"))).alias("b"))
        reached = written(got.select("row", "col", "code", "b.seed", "b.path", F.col("b.d").alias("flow")), "front")
        done = done.union(reached.select("row", "col", "code", "flow"))
        rest = written(rest.join(reached.hint("merge"), ["row", "col"], "left_anti"), "rest")
        front = reached.select("row", "col", "code", "seed", "path")
    return done


def _ways(tile: Tile, sx: int) -> pa.Table:
    """Where the ways of a tile's cells end or leave it (``next, ended, cells``; null: a way without end), and the same of each cell along its edge and of the ends of those (``node, next``)."""
    flow, cell = np.asarray(pc.fill_null(tile.table.column("flow").combine_chunks(), 0)), tile.row * sx + tile.col
    here = np.arange(len(cell))
    to, goal, leaves = here.copy(), cell.copy(), np.zeros(len(cell), bool)
    for d, (r, c) in enumerate(STEPS, 1):
        at = tile.beside(r, c)
        k, out = flow == d, (flow == d) & (at < 0)
        to[k & ~out] = at[k & ~out]
        goal[out], leaves[out] = goal[out] + (r * sx + c), True
    last = to == here
    for _ in range(len(cell).bit_length()):
        if last[to].all():
            break
        to = to[to]
    lost, n = ~last[to], np.bincount(to, minlength=len(cell))
    at = np.flatnonzero(n)
    edge = (tile.row % SIDE == 0) | (tile.row % SIDE == SIDE - 1) | (tile.col % SIDE == 0) | (tile.col % SIDE == SIDE - 1)
    edge[to[edge & ~lost & ~leaves[to]]] = True
    edge = np.flatnonzero(edge & ~lost)
    sums = pa.table({"node": pa.nulls(len(at), pa.int64()), "next": pa.array(goal[at], mask=~last[at]), "ended": ~(last & leaves)[at], "cells": n[at]})
    return pa.concat_tables([sums, pa.table({"node": cell[edge], "next": goal[to[edge]], "ended": ~leaves[to[edge]], "cells": np.zeros(len(edge), np.int64)})])


def catchments(flow: DataFrame, sx: int, cell_area: float = 1.0) -> DataFrame:
    """``outlet, cells, area`` of each end of the flow; ways without end have the outlet null.

    A tile follows its own ways; only the cells along tiles' edges are linked to each other.
    """
    ways = dealt(flow.select("row", "col", "flow")).applyInArrow(lambda table: _ways(Tile(table), sx), "node long, next long, ended boolean, cells long")
    ways = written(ways, "ways")
    ends = jump(ways.where("node is not null").select("node", "next"), AT_ONCE).select(F.col("node").alias("next"), F.col("next").alias("outlet"))
    sums = ways.where("node is null")
    beyond = sums.where("not ended").join(ends.hint("merge"), "next", "left").select("outlet", "cells")
    both = sums.where("ended").select(F.col("next").alias("outlet"), "cells").union(beyond)
    return both.groupBy("outlet").agg(F.sum("cells").alias("cells")).select("outlet", "cells", (F.col("cells") * cell_area).alias("area"))


#: Lattice rows whose pits are numbered in one task.
NUMBERED = 4096


def pits(cells: DataFrame, sy: int, sx: int) -> DataFrame:
    """``pit, code, cells, first_cell``: maximal 8-connected sets of equal codes with nothing lower around and no sample at an edge, numbered from 1 in raster order of their first cells.

    A tile counts its own sets; those that go on over its edge are put together afterwards.
    """

    def run(table: pa.Table) -> pa.Table:
        tile = Tile(table)
        first, goes_on = _levels(tile)
        spilt = _ends(tile, sy, sx) | (_strict(tile, sy, sx) > 0)
        return _own(tile, comp=tile.row[first] * sx + tile.col[first], wide=goes_on[first], spilt=spilt)

    level = written(dealt(cells.select("row", "col", "code"), 1).applyInArrow(run, _schema(cells, comp=LongType(), wide=BooleanType(), spilt=BooleanType())), "level")
    sums = level.groupBy("comp").agg(F.min("code").alias("code"), F.count(F.lit(1)).alias("cells"), F.max("spilt").alias("spilt"), F.max("wide").alias("wide"))
    sums = written(sums.where("wide or not spilt"), "sets")
    merged = components(links(level.where("wide").where(rim()).withColumn("k", F.col("code")), STEPS[2:6])).select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    wide = sums.where("wide").join(merged.hint("merge"), "comp", "left").groupBy(F.coalesce("whole", "comp").alias("comp")).agg(F.min("code").alias("code"), F.sum("cells").alias("cells"), F.max("spilt").alias("spilt"))
    kept = sums.where("not wide").select("comp", "code", "cells").union(wide.where("not spilt").select("comp", "code", "cells"))
    kept = written(kept.withColumn("part", F.floor(F.col("comp") / (sx * NUMBERED))), "pits")
    before = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("comp"))
    return kept.join(before.hint("merge"), "part").select(number.cast("int").alias("pit"), "code", "cells", F.col("comp").alias("first_cell"))
