"""The depression hierarchy: pits, how they fill and merge, and what follows for each node.

Filling is one sequence of events in order of height, so a lattice is flooded by one kernel; everything that follows from its nodes and
labels is relational. Node 0 is what drains off the map, nodes 1 to ``leaves`` are pits, then merged basins in order of their merging.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import codecs
from tarn.operators import graph
from tarn.runtime import written

#: Samples of a hypsometric curve below and above the spill; fixed values.
BELOW, ABOVE = 48, 16


def _pits(code: np.ndarray) -> list[list[int]]:
    """Cells of each pit, in raster order of first cells."""
    sy, sx = code.shape
    seen = np.zeros(code.size, bool)
    flat = code.ravel()
    out = []
    for start in range(code.size):
        if seen[start]:
            continue
        seen[start] = True
        group, good = [start], True
        for i in group:
            r, c = divmod(i, sx)
            good &= 0 < r < sy - 1 and 0 < c < sx - 1
            for rr in range(max(0, r - 1), min(sy, r + 2)):
                for cc in range(max(0, c - 1), min(sx, c + 2)):
                    k = rr * sx + cc
                    if flat[k] < flat[i]:
                        good = False
                    elif flat[k] == flat[i] and not seen[k]:
                        seen[k] = True
                        group.append(k)
        if good:
            out.append(group)
    return out


def flood(code: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """Nodes and labels of one lattice of integer codes.

    Cells come in order of the level at which water reaches them, first come first served within a level. A cell takes the label of the one
    that reached it. Where a cell meets one that came before it and belongs to another set, the two sets merge at that level; a set that
    meets what drains off the map drains there.
    """
    sy, sx = code.shape
    flat = code.ravel().astype(np.int64)
    pits = _pits(code)
    label = np.full(flat.size, -1, np.int64)
    done = np.zeros(flat.size, bool)
    queue: list[tuple[int, int, int]] = []
    number = {i: n for n, group in enumerate(pits, 1) for i in group}
    turn = 0
    for i in range(flat.size):
        r, c = divmod(i, sx)
        mine = 0 if r in (0, sy - 1) or c in (0, sx - 1) else number.get(i)
        if mine is not None:
            label[i] = mine
            heapq.heappush(queue, (int(flat[i]), turn, i))
            turn += 1
    nodes = [dict(parent=None, floor_code=None, floor_cell=None, spill_code=None, spill_cell=None, outlet_cell=None, overflow_to=None)]
    nodes += [dict(nodes[0], floor_code=int(flat[g[0]]), floor_cell=g[0]) for g in pits]
    root = list(range(len(nodes)))

    def top(n: int) -> int:
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    while queue:
        level, _, i = heapq.heappop(queue)
        done[i] = True
        r, c = divmod(i, sx)
        for rr in range(max(0, r - 1), min(sy, r + 2)):
            for cc in range(max(0, c - 1), min(sx, c + 2)):
                k = rr * sx + cc
                if label[k] < 0:
                    label[k] = label[i]
                    heapq.heappush(queue, (max(level, int(flat[k])), turn, k))
                    turn += 1
                elif done[k]:
                    a, b = top(label[i]), top(label[k])
                    if a == b:
                        continue
                    ends = {a: (i, k, b), b: (k, i, a)}
                    if 0 in ends:
                        into = 0
                    else:
                        into = len(nodes)
                        low = min((nodes[n]["floor_code"], nodes[n]["floor_cell"]) for n in ends)
                        nodes.append(dict(nodes[0], floor_code=low[0], floor_cell=low[1]))
                        root.append(into)
                    for n, (own, out, other) in ends.items():
                        if n:
                            nodes[n].update(parent=into, spill_code=level, spill_cell=own, outlet_cell=out, overflow_to=other)
                            root[n] = into
    table = pd.DataFrame(nodes)
    table.insert(0, "node", np.arange(len(table)))
    counts = np.bincount(label, minlength=len(table))
    whole = counts.copy()
    for n in range(1, len(table)):  # a parent that isn't the root has a greater number than its children
        p = table["parent"][n]
        if not pd.isna(p) and p != 0:
            whole[int(p)] += whole[n]
    whole[0] = label.size
    table["cells"], table["subtree_cells"] = counts, whole
    table["leaf"] = (table["node"] > 0) & (table["node"] <= len(pits))
    return table, label.reshape(sy, sx)


NODE_SCHEMA = "grid int, node int, parent int, floor_code int, floor_cell long, spill_code int, spill_cell long, outlet_cell long, overflow_to int, cells long, subtree_cells long, leaf boolean"


def _lattice(pdf: pd.DataFrame) -> np.ndarray:
    code = np.full((pdf["row"].max() + 1, pdf["col"].max() + 1), 65535, np.int64)
    code[pdf["row"], pdf["col"]] = pdf["code"]
    return code


def nodes(cells: DataFrame) -> DataFrame:
    """The hierarchy's nodes of each lattice: ``grid`` (which lattice), then as ``flood`` gives them. Cells: ``grid, row, col, code``; missing ones stand at the top."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table, _ = flood(_lattice(pdf))
        table.insert(0, "grid", int(pdf["grid"].iloc[0]))
        for c in ("parent", "floor_code", "floor_cell", "spill_code", "spill_cell", "outlet_cell", "overflow_to"):
            table[c] = table[c].astype("Int64")
        return table

    return cells.select("grid", "row", "col", "code").groupBy("grid").applyInPandas(run, NODE_SCHEMA)


def labels(cells: DataFrame) -> DataFrame:
    """``grid, row, col, code, label``: the node that each cell belongs to first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, label = flood(_lattice(pdf))
        return pdf.assign(label=label[pdf["row"], pdf["col"]])

    return cells.select("grid", "row", "col", "code").groupBy("grid").applyInPandas(run, "grid int, row int, col int, code int, label long")


def axis(floor: Column, spill: Column, top: Column) -> Column:
    """The 64 codes of a node's curve: from floor to spill, then on to the top, rounded half up in integers."""
    s = F.greatest(spill, floor)
    t = F.greatest(top, s)
    low = F.transform(F.sequence(F.lit(0), F.lit(BELOW - 1)), lambda i: F.floor((floor * (BELOW - 1 - i) + s * i + (BELOW - 1) // 2) / (BELOW - 1)).cast("int"))
    high = F.transform(F.sequence(F.lit(1), F.lit(ABOVE)), lambda k: F.floor((s * (ABOVE - k) + t * k + ABOVE // 2) / ABOVE).cast("int"))
    return F.concat(low, high)


def leaf_curves(leaves: DataFrame, cells: DataFrame, cell_area: float = 1.0) -> DataFrame:
    """``label, j, code, area``: how much of a leaf lies at or under each code of its axis. Leaves: ``label, floor_code, spill_code``; cells: ``label, code``."""
    top = cells.groupBy("label").agg(F.max("code").alias("top"))
    lines = leaves.join(top, "label").select("label", F.posexplode(axis(F.col("floor_code"), F.col("spill_code"), F.col("top"))).alias("j", "code"))
    # A cell adds to the first axis code that reaches it, and a running sum does the rest.
    counted = cells.join(leaves.select("label"), "label", "left_semi").groupBy("label", "code").agg(F.count(F.lit(1)).alias("n"))
    both = lines.select("label", "j", "code", F.lit(0).alias("n"), F.lit(1).alias("kind")).unionByName(counted.select("label", F.lit(-1).alias("j"), "code", F.col("n").cast("int").alias("n"), F.lit(0).alias("kind")))
    so_far = Window.partitionBy("label").orderBy("code", "kind", "j").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("area", F.sum("n").over(so_far) * cell_area).where("kind = 1").select("label", "j", "code", "area")


def outflow_heads(tree: DataFrame, cells: DataFrame, low: Column, high: Column) -> DataFrame:
    """``node, head``: the depth of the river at a node's spill: the higher of its two saddle samples, river samples only, as packed; 0 elsewhere.

    Tree: ``node, spill_m, spill_cell, outlet_cell``; cells: ``cell, kind, surface``.
    """
    ends = tree.select("node", "spill_m", F.explode(F.array("spill_cell", "outlet_cell")).alias("cell"))
    river = cells.where("kind = 1").select("cell", codecs.unpack_surface(codecs.pack_surface(F.col("surface"), low, high), low, high).alias("level"))
    got = ends.join(river, "cell").groupBy("node").agg(F.max(F.greatest(F.col("level") - F.col("spill_m"), F.lit(0.0))).alias("head"))
    return tree.select("node").join(got, "node", "left").select("node", F.coalesce("head", F.lit(0.0)).alias("head"))


def _subtree_levels(tree: DataFrame) -> DataFrame:
    """``node, level, lakes``: the highest ``level`` of the lake nodes in each subtree that has any, and whether it has; sent upwards by doubling."""
    now = written(tree.select("node", F.col("parent").alias("to"), F.when(F.col("has_lake"), F.col("level")).alias("level"), F.col("has_lake").alias("lakes")), "levels")
    while not now.where("to is not null").isEmpty():
        sent = now.where("to is not null").groupBy(F.col("to").alias("node")).agg(F.max("level").alias("more"), F.max("lakes").alias("any"))
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("then"))
        both = now.join(sent, "node", "left").join(ahead, "to", "left")
        now = written(both.select("node", F.col("then").alias("to"), F.greatest("level", "more").alias("level"), (F.col("lakes") | F.coalesce("any", F.lit(False))).alias("lakes")), "levels")
    return now.where("lakes").select("node", "level", "lakes")


def unexplained(tree: DataFrame, cell_area: float, *, depth_m: float = 2.0, area_m2: float = 5000.0, limit: int = 500, tolerance: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The top ``limit`` nodes by area times depth that are deep and wide and that no lake explains: ``node, depth, area, score``; and totals, one row ``unexplained, joins_lake``.

    Tree: ``node, parent, overflow_to, floor_m, spill_m, subtree_cells, has_lake, level`` (of a lake node). Left out are nodes with a lake in their
    subtree or above them, then those that spill into a lake at or under its level and ``tolerance`` (give one height step more), then those inside another that is left. The
    totals count all that remain, and those that join a lake. A parent of null or 0 is none.
    """
    inner = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c)
    tree = written(tree.select("node", inner("parent"), inner("overflow_to"), "floor_m", "spill_m", "subtree_cells", "has_lake", F.col("level").cast("double").alias("level")), "tree")
    above = graph.jump(tree.select("node", F.when(~F.col("has_lake"), F.col("parent")).alias("next")))
    lakes = tree.where("has_lake").select(F.col("node").alias("next"), F.col("level").alias("up_level"), F.lit(True).alias("inside"))
    around = written(above.join(lakes, "next").select("node", "up_level", "inside"), "around")
    within = written(_subtree_levels(tree), "within")
    depth, area = F.col("spill_m") - F.col("floor_m"), F.col("subtree_cells") * cell_area
    rows = tree.where(~F.col("has_lake")).select("node", "parent", "overflow_to", "spill_m", depth.alias("depth"), area.alias("area")).where((F.col("depth") >= depth_m) & (F.col("area") >= area_m2))
    rows = rows.join(around, "node", "left_anti").join(within, "node", "left_anti")
    to = tree.select(F.col("node")).join(around, "node", "left").join(within, "node", "left").select(F.col("node").alias("overflow_to"), F.greatest("up_level", "level").alias("lake_level"))
    joins = F.coalesce(F.col("spill_m") <= F.col("lake_level") + tolerance, F.lit(False))
    rows = written(rows.join(to, "overflow_to", "left").withColumn("joins", joins), "candidates")
    left = rows.where("not joins")
    marked = tree.select("node", "parent").join(left.select("node", F.lit(True).alias("cand")), "node", "left")
    ends = graph.jump(marked.select("node", F.when(F.col("cand").isNull(), F.col("parent")).alias("next")))
    nested = ends.join(left.select(F.col("node").alias("next")), "next").select(F.col("node").alias("parent"))
    outer = written(left.join(nested, "parent", "left_anti").select("node", "depth", "area", (F.col("depth") * F.col("area")).alias("score")), "unexplained")
    totals = outer.agg(F.count(F.lit(1)).alias("unexplained")).crossJoin(rows.agg(F.count_if("joins").alias("joins_lake")))
    return outer.orderBy(F.desc("score"), "node").limit(limit), totals
