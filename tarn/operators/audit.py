"""Checks and audits as anti-joins and comparisons; each returns a row for everything that is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.runtime import written


def differences(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Rows that only one of two products has, with ``side``."""
    columns = left.columns
    one = left.exceptAll(right.select(*columns)).withColumn("side", F.lit("left"))
    return one.unionByName(right.select(*columns).exceptAll(left).withColumn("side", F.lit("right")))


def check_tree(tree: DataFrame) -> DataFrame:
    """``node, error`` for nodes (``node, parent, floor_code, spill_code, subtree_cells``) whose parent isn't there, lies lower or has no greater number, or holds fewer cells."""
    up = tree.select(F.col("node").alias("parent"), F.col("spill_code").alias("up_spill"), F.col("floor_code").alias("up_floor"), F.col("subtree_cells").alias("up_cells"))
    rows = tree.where("node > 0").join(up, "parent", "left")
    inner = F.col("parent") > 0
    error = (
        F.when(F.col("parent").isNull() | F.col("up_cells").isNull(), "no parent")
        .when(inner & (F.col("parent") <= F.col("node")), "parent before child")
        .when(inner & (F.col("up_spill") < F.col("spill_code")), "parent spills lower")
        .when(inner & (F.col("up_floor") > F.col("floor_code")), "parent's floor is higher")
        .when(F.col("spill_code") < F.col("floor_code"), "spill under floor")
        .when(F.col("up_cells") < F.col("subtree_cells"), "parent holds fewer cells")
    )
    return rows.select("node", error.alias("error")).where("error is not null")


def check_links(segments: DataFrame, junctions: DataFrame, lakes: DataFrame) -> DataFrame:
    """``seg_id, error``: links to segments that aren't there or back to themselves, discharge that falls downstream, junctions with unknown lakes. Segments: ``seg_id, downstream, discharge``."""
    down = segments.select(F.col("seg_id").alias("downstream"), F.col("discharge").alias("below"))
    linked = segments.where("downstream is not null").join(down, "downstream", "left")
    error = F.when(F.col("below").isNull(), "no such segment").when(F.col("downstream") == F.col("seg_id"), "its own downstream").when(F.col("below") < F.col("discharge"), "less discharge downstream")
    one = linked.select("seg_id", error.alias("error")).where("error is not null")
    two = junctions.join(lakes.select("lake_id"), "lake_id", "left_anti").select("seg_id", F.lit("unknown lake").alias("error"))
    return one.union(two)


def match_lakes(cells: DataFrame, tree: DataFrame, levels: DataFrame, *, tolerance: float = 0.05, least: float = 0.3) -> DataFrame:
    """``lake_id, node, iou, status``: the basin that holds each lake best.

    Cells: ``label, lake_id, h``; tree: ``node, parent, spill_m, head``; levels: ``lake_id, level, regulated``. A lake's candidates are the nodes that label its
    samples and all above them; a candidate's pool is what its subtree holds at or under the lake's level, but no higher than the basin holds water.
    The best is the candidate of the greatest overlap over union, the smaller node among equals. Trees are climbed a generation a round.
    """
    tree, cells = written(tree, "tree"), written(cells, "labelled")
    up = tree.where("node > 0 and parent > 0").select("node", "parent")
    now = written(tree.where("node > 0").select(F.col("node").alias("under"), "node"), "above")
    pairs = now
    while not now.isEmpty():
        now = written(now.join(up, "node").select("under", F.col("parent").alias("node")), "above")
        pairs = pairs.union(now)
    known = levels.where("level is not null")
    mask = cells.where("lake_id > 0").join(known, "lake_id")
    sizes = mask.groupBy("lake_id").agg(F.count(F.lit(1)).alias("mask"))
    climbed = mask.join(pairs, F.col("label") == F.col("under")).select("lake_id", "node").distinct()
    held = climbed.join(tree.select("node", "spill_m", "head"), "node").join(known.select("lake_id", "level"), "lake_id")
    held = held.withColumn("top", F.least("level", F.col("spill_m") + F.coalesce("head", F.lit(0.0))) + tolerance)
    inside = held.join(pairs, "node").join(cells.select("label", F.col("lake_id").alias("own"), "h"), F.col("under") == F.col("label")).where("h <= top")
    pool = inside.groupBy("lake_id", "node").agg(F.count(F.lit(1)).alias("pool"), F.count_if(F.col("own") == F.col("lake_id")).alias("inter"))
    iou = F.col("inter") / (F.col("pool") + F.col("mask") - F.col("inter"))
    best = pool.join(sizes, "lake_id").groupBy("lake_id").agg(F.max(F.struct(iou.alias("iou"), (-F.col("node")).alias("n"))).alias("b")).select("lake_id", (-F.col("b.n")).alias("node"), "b.iou").where(F.col("iou") >= least)
    rows = levels.join(best, "lake_id", "left").join(tree.select("node", "spill_m", "head"), "node", "left")
    over = F.col("level") - F.col("spill_m")
    status = F.when(F.col("level").isNull(), "no_level").when(F.col("node").isNull(), "no_node").when(over <= tolerance, "ok").when(over <= F.coalesce("head", F.lit(0.0)) + tolerance, "held_by_outflow").otherwise("level_above_spill")
    return rows.select("lake_id", "node", "iou", status.alias("status"))
