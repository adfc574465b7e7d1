"""Where rivers meet lakes: channels cut on into the lake bed, sills opened only where the lake can't run out, and riffles that hold it at its outlets."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.hydraulics import smoothstep
from tarn.operators.geometry import every
from tarn.operators.spatial import escapes
from tarn.operators.stencil import neighbours
from tarn.runtime import written


@dataclass(frozen=True)
class MouthRules:
    """Reach and flare of a mouth, its least depth, throats, margins, what counts as a hollow."""

    widths: float = 12.0
    least_m: float = 40.0
    most_m: float = 250.0
    grade: float = 0.01
    inflow_flare: float = 0.35
    outflow_flare: float = 0.25
    depth_m: float = 0.5
    throat_cells: float = 1.5
    margin_m: float = 0.1
    check_m: float = 1500.0
    hollow_samples: int = 25
    hollow_share: float = 0.01
    riffle_m: float = 0.1


def _points(mouths: DataFrame, paths: DataFrame, bed: DataFrame, spacing_m: float, rules: MouthRules) -> DataFrame:
    """Points along each mouth's path, in cells: ``mouth, x, y, s`` (metres past the mouth)``, hold, fade, lake_id, level, outlet, w0, d0, flare``.

    The first vertex of a path is the river's last, the second the mouth. An inlet's channel fades over the second half of its reach; an outlet's holds its depth
    until the lake bed under it is deeper.
    """
    along = every(paths.select("mouth", "ord", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), 0.5, key="mouth")
    ends = paths.where("ord < 2").groupBy("mouth").agg(F.max(F.when(F.col("ord") == 0, F.struct("x", "y"))).alias("a"), F.max(F.when(F.col("ord") == 1, F.struct("x", "y"))).alias("b"))
    gap = ends.select("mouth", (F.sqrt((F.col("b.x") - F.col("a.x")) ** 2 + (F.col("b.y") - F.col("a.y")) ** 2)).alias("gap"))
    outlet = F.col("kind") == "outflow"
    w0 = F.greatest("half_width", F.lit(spacing_m / 2))
    reach = F.least(F.greatest(w0 * 2 * rules.widths, F.lit(rules.least_m)), F.lit(rules.most_m))
    facts = mouths.select("mouth", "lake_id", "level", outlet.alias("outlet"), w0.alias("w0"), reach.alias("reach"), (F.greatest("depth", F.lit(rules.depth_m)) + F.when(outlet, rules.margin_m).otherwise(0.0)).alias("d0"), F.when(outlet, rules.outflow_flare).otherwise(rules.inflow_flare).alias("flare"))
    rows = along.join(gap, "mouth").join(facts, "mouth").withColumn("s", (F.col("arc") - F.col("gap")) * spacing_m)
    under = rows.withColumn("row", F.rint("y").cast("int")).withColumn("col", F.rint("x").cast("int")).join(bed.select("row", "col", F.col("h").alias("bed")), ["row", "col"], "left")
    enough = (F.col("s") > 0) & (F.col("level") - F.col("bed") >= F.col("d0") + F.greatest("s", F.lit(0.0)) * rules.grade + rules.margin_m)
    held = under.groupBy("mouth").agg(F.min(F.when(enough, F.col("s"))).alias("deep"), F.max("s").alias("end"), F.max("reach").alias("r"), F.max("outlet").alias("o"))
    hold = held.select("mouth", F.when(F.col("o"), F.coalesce("deep", "end")).otherwise(F.col("r") / 2).alias("hold"))
    return rows.join(hold, "mouth").where(F.col("s") <= F.col("hold") + F.col("reach") / 2).select("mouth", "x", "y", "s", "hold", (F.col("reach") / 2).alias("fade"), "lake_id", "level", "outlet", "w0", "d0", "flare")


def cut(cells: DataFrame, mouths: DataFrame, paths: DataFrame, size: tuple[int, int], spacing_m: float, rules: MouthRules = MouthRules()) -> DataFrame:
    """``mouth, row, col, target, opened``: lake samples that mouths' channels lower, and to what; ``opened`` ones lie in the lake's shore ring.

    Cells: ``row, col, h, kind, lake_id, island``; mouths: ``mouth, kind, lake_id, level, depth, half_width`` (metres); paths: ``mouth, ord, x, y`` in cells. The channel
    has its full depth within the river's own width and at the sample nearest its line, and rises to nothing at its flared edge. The ring stays at the waterline but
    in the mouth's own throat, and samples at the map's edge stay as they are.
    """
    points = written(_points(mouths, paths, cells, spacing_m, rules), "points")
    widest = points.agg(F.max((F.col("w0") + F.col("flare") * F.least(F.greatest("s", F.lit(0.0)), F.col("fade"))) / spacing_m)).first()[0]
    radius = int(np.ceil(widest or 0)) + 1
    lake = cells.where("kind = 2 and not island").select("row", "col", "h", "lake_id")
    others = neighbours(cells, F.when(F.col("kind") == 2, F.col("lake_id")).otherwise(0).alias("other")).join(lake.select("row", "col", "lake_id"), ["row", "col"])
    inner = others.where("other = lake_id").groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).where("n = 8").select("row", "col", F.lit(True).alias("inner"))
    edge = F.col("row").isin(0, size[0] - 1) | F.col("col").isin(0, size[1] - 1)
    own = lake.where(~edge).join(inner, ["row", "col"], "left").withColumn("ring", F.col("inner").isNull()).drop("inner")
    steps = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    near = points.withColumn("dr", steps).withColumn("row", (F.rint("y") + F.col("dr")).cast("int")).withColumn("dc", steps).withColumn("col", (F.rint("x") + F.col("dc")).cast("int"))
    far = F.sqrt((F.col("row") - F.col("y")) ** 2 + (F.col("col") - F.col("x")) ** 2) * spacing_m
    best = near.withColumn("far", far).where(F.col("far") <= radius * spacing_m).groupBy("mouth", "row", "col").agg(F.min(F.struct("far", "s", "hold", "fade", "lake_id", "level", "outlet", "w0", "d0", "flare")).alias("p"))
    rows = best.select("mouth", "row", "col", "p.*").withColumnRenamed("lake_id", "into").join(own, ["row", "col"]).where("into = lake_id")
    s = F.greatest("s", F.lit(0.0))
    wide = F.col("w0") + F.col("flare") * F.least(s, F.col("fade"))
    core = F.col("far") <= F.greatest("w0", F.lit(0.75 * spacing_m))
    across = F.when(core, 1.0).otherwise(F.lit(1.0) - smoothstep((F.col("far") - wide / 2) / F.greatest(wide / 2, F.lit(1e-6))))
    fade = F.lit(1.0) - smoothstep((F.col("s") - F.col("hold")) / F.greatest("fade", F.lit(1e-6)))
    depth = (F.col("d0") + s * rules.grade) * fade * across
    throat = core & (F.col("s") <= rules.throat_cells * spacing_m)
    made = rows.withColumn("cut", depth).where((F.col("cut") > 0) & (~F.col("ring") | throat)).withColumn("target", F.col("level") - F.col("cut"))
    return made.where("target < h").select("mouth", "row", "col", "lake_id", "level", "outlet", "target", F.col("ring").alias("opened"), F.col("h").alias("before"))


def leaking_inlets(cut_cells: DataFrame, cells: DataFrame, size: tuple[int, int], spacing_m: float, rules: MouthRules = MouthRules()) -> DataFrame:
    """``mouth, how``: inlets behind whose opened sill the lake would find its way to the map's edge or out of the window that is looked at (``check_m`` around)."""
    throat = written(cut_cells.where("opened and not outlet").select("mouth", "row", "col", "lake_id", "level"), "throats")
    reach = int(rules.check_m / spacing_m) + 1
    box = throat.groupBy("mouth", "lake_id", "level").agg((F.min("row") - reach).alias("r0"), (F.max("row") + reach).alias("r1"), (F.min("col") - reach).alias("c0"), (F.max("col") + reach).alias("c1"))
    box = box.select("mouth", "lake_id", "level", *(F.greatest(c, F.lit(0)).alias(c) for c in ("r0", "c0")), F.least("r1", F.lit(size[0] - 1)).alias("r1"), F.least("c1", F.lit(size[1] - 1)).alias("c1"))
    tile = 128
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / tile).cast("int"), F.floor(F.col(b) / tile).cast("int")))
    dealt = box.withColumn("ty", span("r0", "r1")).withColumn("tx", span("c0", "c1")).withColumnRenamed("lake_id", "own")
    met = cells.withColumn("ty", F.floor(F.col("row") / tile).cast("int")).withColumn("tx", F.floor(F.col("col") / tile).cast("int")).join(dealt, ["ty", "tx"]).where(F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1")))
    wet = met.where((F.col("h") < F.col("level")) & ~((F.col("kind") == 2) & (F.col("lake_id") == F.col("own")) & ~F.col("island")))
    beside = neighbours(throat, F.col("mouth").alias("by")).select("row", "col", F.col("by").alias("mouth")).distinct().withColumn("seed", F.lit(True))
    rim = (F.col("row") == F.col("r0")) | (F.col("row") == F.col("r1")) | (F.col("col") == F.col("c0")) | (F.col("col") == F.col("c1"))
    flood = wet.withColumn("rim", rim).join(beside, ["mouth", "row", "col"], "left").select(F.col("mouth").alias("id"), "row", "col", F.coalesce("seed", F.lit(False)).alias("seed"), "rim")
    return escapes(flood, *size).withColumnRenamed("id", "mouth")


def connect_heights(bed: np.ndarray, allowed: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For every allowed sample the height that water must reach to join it to a seed: the highest bed on the best way, 8-connected; infinite where there is none."""
    out = np.full(bed.shape, np.inf)
    queue = [(float(bed[r, c]), int(r), int(c)) for r, c in np.argwhere(seeds)]
    for h, r, c in queue:
        out[r, c] = h
    heapq.heapify(queue)
    while queue:
        h, r, c = heapq.heappop(queue)
        if h > out[r, c]:
            continue
        for rr in range(max(r - 1, 0), min(r + 2, bed.shape[0])):
            for cc in range(max(c - 1, 0), min(c + 2, bed.shape[1])):
                if allowed[rr, cc] and max(h, bed[rr, cc]) < out[rr, cc]:
                    out[rr, cc] = max(h, float(bed[rr, cc]))
                    heapq.heappush(queue, (out[rr, cc], rr, cc))
    return out


def drained(bed: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """How many allowed samples drain to each by steepest descent among them: pointers to the lowest lower neighbour, followed by doubling."""
    rows, cols = bed.shape
    held = np.pad(np.where(allowed, bed, np.inf), 1, constant_values=np.inf)
    place = np.arange(bed.size).reshape(bed.shape)
    best, to = np.where(allowed, bed, np.inf), place.copy()
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            other = held[1 + dr : 1 + dr + rows, 1 + dc : 1 + dc + cols]
            lower = allowed & (other < best)
            best, to = np.where(lower, other, best), np.where(lower, place + dr * cols + dc, to)
    to = to.ravel()
    while (to[to] != to).any():
        to = to[to]
    return np.bincount(to[allowed.ravel()], minlength=bed.size).reshape(bed.shape)


def crest_of(bed: np.ndarray, own: np.ndarray, throats: np.ndarray, rules: MouthRules = MouthRules()) -> float:
    """The highest rim of a hollow in a lake's bed that a real share of the lake drains into, and a margin; minus infinity without such a hollow."""
    joined = connect_heights(bed, own | throats, throats)
    hollow = own & np.isfinite(joined) & (joined > bed + 1e-3)
    counts = drained(bed, own)
    seen, crest = np.zeros(bed.shape, bool), -np.inf
    for r, c in np.argwhere(hollow):
        if seen[r, c]:
            continue
        seen[r, c] = True
        front, members = [(r, c)], []
        while front:
            a, b = front.pop()
            members.append((a, b))
            for aa in range(max(a - 1, 0), min(a + 2, bed.shape[0])):
                for bb in range(max(b - 1, 0), min(b + 2, bed.shape[1])):
                    if hollow[aa, bb] and not seen[aa, bb]:
                        seen[aa, bb] = True
                        front.append((aa, bb))
        at = tuple(np.array(members).T)
        if counts[at].sum() >= max(rules.hollow_samples, rules.hollow_share * own.sum()):
            crest = max(crest, float(joined[at].max()) + rules.margin_m)
    return crest


def crests(bed: DataFrame, opened: DataFrame, rules: MouthRules = MouthRules()) -> DataFrame:
    """``lake_id, crest`` of lakes with an opened outlet. Bed: ``row, col, h, lake_id`` of their own samples as carved; opened: ``lake_id, row, col``. A lake is one group."""

    def run(table: pa.Table) -> pa.Table:
        pdf = table.to_pandas()
        r0, c0 = pdf["row"].min(), pdf["col"].min()
        shape = (pdf["row"].max() - r0 + 1, pdf["col"].max() - c0 + 1)
        r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        h, own, throat = np.full(shape, np.inf), np.zeros(shape, bool), np.zeros(shape, bool)
        h[r, c], own[r, c], throat[r, c] = pdf["h"], True, pdf["throat"]
        return pa.table({"lake_id": pa.array([int(pdf["lake_id"].iloc[0])], pa.int32()), "crest": pa.array([crest_of(h, own, throat, rules)], pa.float64())})

    marked = opened.select("lake_id", "row", "col", F.lit(True).alias("throat")).distinct()
    rows = bed.join(opened.select("lake_id").distinct(), "lake_id", "left_semi").join(marked, ["lake_id", "row", "col"], "left")
    return rows.select(F.col("lake_id").cast("int").alias("lake_id"), "row", "col", F.col("h").cast("double").alias("h"), F.coalesce("throat", F.lit(False)).alias("throat")).groupBy("lake_id").applyInArrow(run, "lake_id int, crest double")


def riffles(cut_cells: DataFrame, mouths: DataFrame, cells: DataFrame, lake_crests: DataFrame, rules: MouthRules = MouthRules()) -> tuple[DataFrame, DataFrame]:
    """River samples raised beside opened outlets (``mouth, row, col, top``), and outlets that stay shut (``mouth, why``).

    The riffle stands a margin above the river's own bed and at the lake's crest at least. It has no room close under the level, and none where the land beside it is lower. Cells: ``row, col, h, kind``.
    """
    opened = cut_cells.where("opened and outlet").select("mouth", "row", "col", "lake_id", "level")
    depth = mouths.select("mouth", (F.greatest("depth", F.lit(rules.depth_m)) + rules.margin_m).alias("d0"))
    facts = opened.select("mouth", "lake_id", "level").distinct().join(depth, "mouth").join(lake_crests, "lake_id", "left")
    facts = facts.withColumn("top", F.greatest(F.col("level") - F.col("d0") + 2 * rules.margin_m, F.coalesce("crest", F.lit(float("-inf")))))
    river = neighbours(opened, F.col("mouth").alias("by")).select("row", "col", F.col("by").alias("mouth")).distinct().join(cells.where("kind = 1").select("row", "col", "h"), ["row", "col"])
    around = neighbours(opened.select("row", "col", "mouth").union(river.select("row", "col", "mouth")), F.col("mouth").alias("by")).select("row", "col", F.col("by").alias("mouth")).distinct()
    banks = around.join(cells.where("kind = 0").select("row", "col", "h"), ["row", "col"]).groupBy("mouth").agg(F.min("h").alias("bank"))
    known = written(facts.join(banks, "mouth", "left").withColumn("why", F.when(F.col("top") > F.col("level") - rules.riffle_m, "no_room").when(F.col("bank") - rules.margin_m < F.col("top"), "low_banks")), "riffles")
    raised = river.join(known.where("why is null").select("mouth", "top"), "mouth").where("h < top").select("mouth", "row", "col", "top")
    return raised, known.where("why is not null").select("mouth", "why")


def carve(cells: DataFrame, mouths: DataFrame, paths: DataFrame, size: tuple[int, int], spacing_m: float, rules: MouthRules = MouthRules()) -> tuple[DataFrame, DataFrame]:
    """The bed with all mouths, ``row, col, h``, and what became of each mouth: ``mouth, kind, lowered`` (samples)``, shut`` (why its sill was put back, or null)``, raised`` (riffle samples).

    Of several mouths the lowest cut counts. Sills of leaking inlets and of outlets without a riffle are as before.
    """
    made = written(cut(cells, mouths, paths, size, spacing_m, rules), "mouths")
    leaks = written(leaking_inlets(made, cells, size, spacing_m, rules), "leaks")
    lowest = made.groupBy("row", "col").agg(F.min("target").alias("target"))
    carved = cells.where("kind = 2").join(lowest, ["row", "col"], "left").select("row", "col", F.coalesce("target", F.col("h").cast("double")).alias("h"), "lake_id")
    raised, shut = riffles(made, mouths, cells, crests(carved, made.where("opened and outlet").select("lake_id", "row", "col"), rules), rules)
    raised = written(raised, "raised")
    back = written(leaks.select("mouth", F.col("how").alias("why")).union(shut), "shut")
    kept = made.join(back, "mouth", "left").where(~(F.col("opened") & F.col("why").isNotNull()))
    target = kept.groupBy("row", "col").agg(F.min("target").alias("target"))
    top = raised.groupBy("row", "col").agg(F.max("top").alias("top"))
    bed = cells.join(target, ["row", "col"], "left").join(top, ["row", "col"], "left").select("row", "col", F.coalesce("top", "target", F.col("h").cast("double")).alias("h"))
    lowered = kept.groupBy("mouth").agg(F.count(F.lit(1)).alias("lowered"))
    up = raised.groupBy("mouth").agg(F.count(F.lit(1)).alias("raised"))
    report = mouths.select("mouth", "kind").join(lowered, "mouth", "left").join(back.select("mouth", F.col("why").alias("shut")), "mouth", "left").join(up, "mouth", "left")
    return bed, report.select("mouth", "kind", F.coalesce("lowered", F.lit(0)).alias("lowered"), "shut", F.coalesce("raised", F.lit(0)).alias("raised"))
