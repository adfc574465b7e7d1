"""Operators on the depression tree as a table: intervals of subtrees, what lies below a node, heads held down by lakes, curves of inner nodes.

A tree is ``node, parent`` with one root, 0, whose parent is null. What goes down or up the tree takes logarithmically many rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.graph import downstream_sums
from tarn.operators.hierarchy import ABOVE, BELOW
from tarn.runtime import written

#: Flags of a node; fixed values.
LEAF, HAS_SPILL, OFF_MAP, OCEAN, AUTHORED, MINOR, HEAD_CAPPED = 1, 2, 4, 8, 16, 32, 128
#: Siblings whose places are summed up together in one task.
SIBLINGS = 4096


def _before_siblings(sized: DataFrame) -> DataFrame:
    """``node, parent, size, before``: the sizes of a node's siblings of smaller numbers. Siblings go by blocks of node numbers, so that a parent of very many is no single task."""
    blocked = sized.withColumn("block", F.floor(F.col("node") / SIBLINGS))
    blocks = blocked.where("parent is not null").groupBy("parent", "block").agg(F.sum("size").alias("held"))
    up_to = Window.partitionBy("parent").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("parent", "block", F.coalesce(F.sum("held").over(up_to), F.lit(0)).alias("base"))
    within = Window.partitionBy("parent", "block").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocked.where("parent is not null").withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    children = inside.join(bases, ["parent", "block"]).select("node", "parent", "size", (F.col("base") + F.col("inside")).alias("before"))
    return children.union(sized.where("parent is null").select("node", "parent", "size", F.lit(0).cast("long")))


def sums_to_root(steps: DataFrame) -> DataFrame:
    """``node, total``: the sum of ``step`` over a node and all nodes above it. ``steps``: ``node, parent, step``; each round doubles the reach."""
    now = written(steps.select("node", F.col("parent").alias("to"), F.col("step").alias("total")), "sums")
    while not now.where("to is not null").isEmpty():
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("then"), F.col("total").alias("more"))
        now = written(now.join(ahead, "to", "left").select("node", F.col("then").alias("to"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")), "sums")
    return now.select("node", "total")


def subtree_intervals(tree: DataFrame) -> DataFrame:
    """``node, tin, tout``: ``a`` is in the subtree of ``b`` where ``b.tin <= a.tin < b.tout``; children are numbered in the order of their ids, the root is 0.

    A node's number is one more than its parent's, and the sizes of the subtrees of earlier siblings more; so it is a sum on the way up.
    """
    sizes = downstream_sums(tree.select("node", F.col("parent").alias("next"), F.lit(1).cast("long").alias("value")))
    sized = written(tree.select("node", "parent").join(sizes.withColumnRenamed("total", "size"), "node"), "sized")
    step = F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.col("before") + 1)
    placed = written(_before_siblings(sized).withColumn("step", step.cast("long")), "placed")
    numbers = sums_to_root(placed)
    return placed.join(numbers, "node").select("node", F.col("total").alias("tin"), (F.col("total") + F.col("size")).alias("tout"))


def lake_sample_levels(samples: DataFrame, levels: DataFrame) -> DataFrame:
    """``node, own``: the lowest level of the lakes whose samples a node labels itself. Samples: ``label, lake_id`` (0: none); levels: ``lake_id, level``; a level that is null or not finite is none."""
    known = levels.where(F.col("level").isNotNull() & ~F.isnan("level") & (F.abs("level") < float("inf")))
    pairs = samples.where("lake_id > 0 and label > 0").select("label", "lake_id").distinct()
    return pairs.join(known, "lake_id").groupBy(F.col("label").alias("node")).agg(F.min("level").alias("own"))


def lowest_levels_below(tree: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """``node, low``: the lowest level of a lake node below a node, or of lakes that it or a node below labels (``own``: ``node, own``); null where there is none.

    Tree: ``node, parent, authored`` (whether it is a lake's node)``, level``. What a node sends up is the lower of its own level and what it
    got; nothing goes on to the root.
    """
    inner = F.when(F.col("parent") > 0, F.col("parent"))
    start = tree.select("node", inner.alias("to"), F.when(F.col("authored"), F.col("level")).alias("level"))
    held = start.withColumn("low", F.lit(None).cast("double")) if own is None else start.join(own.withColumnRenamed("own", "low"), "node", "left")
    # now.low: the lowest on the way so far; now.sent: what goes up to a node 2**k above.
    now = written(held.select("node", "to", "low", F.least("level", "low").alias("sent")), "low")
    while not now.where("to is not null").isEmpty():
        got = now.where("to is not null").groupBy(F.col("to").alias("node")).agg(F.min("sent").alias("got"))
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("then"))
        both = now.join(got, "node", "left").join(ahead, "to", "left")
        now = written(both.select("node", F.col("then").alias("to"), F.least("low", "got").alias("low"), F.least("sent", "got").alias("sent")), "low")
    return now.select("node", "low")


def capped_heads(tree: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """``node, head, capped``: heads, those of nodes that are no lake's held no higher than the lowest lake inside. Tree: ``node, parent, authored, level, spill_m, head``."""
    low = lowest_levels_below(tree, own)
    room = F.greatest(F.col("low") - F.col("spill_m"), F.lit(0.0))
    bites = F.coalesce(F.col("low").isNotNull() & ~F.col("authored") & (F.col("head") > room), F.lit(False))
    return tree.join(low, "node").select("node", F.when(bites, room).otherwise(F.col("head")).alias("head"), bites.alias("capped"))


def cap_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: ``heads_capped_below_a_lake, cap_median_m, cap_max_m``, rounded to millimetres."""
    cut = F.col("b.head") - F.col("a.head")
    rows = before.alias("b").join(after.where("capped").alias("a"), "node").select(cut.alias("cut"))
    return rows.agg(F.count(F.lit(1)).alias("heads_capped_below_a_lake"), F.round(F.coalesce(F.median("cut"), F.lit(0.0)), 3).alias("cap_median_m"), F.round(F.coalesce(F.max("cut"), F.lit(0.0)), 3).alias("cap_max_m"))


def flagged(flags: Column, flag: int, when: Column) -> Column:
    """``flags`` with one more of them set where ``when`` holds."""
    return F.when(when, flags.bitwiseOR(F.lit(flag))).otherwise(flags)


def axis_codes(floor: np.ndarray, spill: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The 64 codes of each node's curve, a row each: in integers, rounded half up, from floor to spill, then on to the top."""
    floor, spill = floor.astype(np.int64)[:, None], np.maximum(spill, floor).astype(np.int64)[:, None]
    top = np.maximum(top.astype(np.int64)[:, None], spill)
    i, k = np.arange(BELOW), np.arange(1, ABOVE + 1)
    low = (floor * (BELOW - 1 - i) + spill * i + (BELOW - 1) // 2) // (BELOW - 1)
    return np.concatenate([low, (spill * (ABOVE - k) + top * k + ABOVE // 2) // ABOVE], 1)


def sampled_curve(axis: np.ndarray, area: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The area of a curve at codes: straight between its own codes, 0 below the first, the last beyond the end; of equal codes the last counts."""
    j = np.searchsorted(axis, at, "right")
    left, right = np.clip(j - 1, 0, len(axis) - 1), np.clip(j, 0, len(axis) - 1)
    width = axis[right] - axis[left]
    share = np.divide(at - axis[left], width, out=np.zeros(len(at)), where=width > 0)
    value = area[left] + share * (area[right] - area[left])
    return np.where(j == 0, 0.0, value)


def inner_curves(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """``grid, node, j, code, area`` of all nodes but the root: leaves as given, inner ones the sums of their children's curves at their own codes.

    Nodes: ``grid, node, parent, floor_code, spill_code, top_code``; leaves: ``grid, node, area`` (64 of them). A parent has a greater number than its
    children, so a lattice's nodes are composed in one pass; areas are kept as 32-bit floats and summed as 64-bit ones, children in the
    order of their numbers. A lattice is one group, whose size its flood bounds already: 256 bytes a node.
    """
    schema = "grid int, node int, j int, code int, area float"

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("node").to_pandas()
        node, parent = rows["node"].to_numpy(), rows["parent"].fillna(-1).to_numpy(np.int64)
        place = {int(n): i for i, n in enumerate(node)}
        # The top of an inner node is the highest of its subtree.
        top = rows["top_code"].to_numpy(np.int64).copy()
        for i, p in enumerate(parent):
            if p in place and p > 0:
                top[place[p]] = max(top[place[p]], top[i])
        axis = axis_codes(rows["floor_code"].to_numpy(), rows["spill_code"].to_numpy(), top)
        area = np.zeros((len(node), BELOW + ABOVE), np.float32)
        sums: dict[int, np.ndarray] = {}
        for i, given in enumerate(rows["area"]):
            area[i] = given if given is not None else sums.pop(int(node[i]), 0.0)
            if parent[i] in place and parent[i] > 0:
                at = place[parent[i]]
                sums[int(parent[i])] = sums.get(int(parent[i]), 0.0) + sampled_curve(axis[i], area[i].astype(float), axis[at])
        n, width = axis.shape
        columns = [np.repeat(rows["grid"].to_numpy(np.int32), width), np.repeat(node.astype(np.int32), width), np.tile(np.arange(width, dtype=np.int32), n), axis.ravel().astype(np.int32), area.ravel()]
        return pa.table(columns, names=["grid", "node", "j", "code", "area"])

    return nodes.where("node > 0").join(leaves, ["grid", "node"], "left").groupBy("grid").applyInArrow(run, schema)
