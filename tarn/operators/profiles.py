"""Running-window operators along river lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shape_profile(vertices: DataFrame, radius: int, *, seed: str | None = None, key: str = "seg_id") -> DataFrame:
    """``seg_id, ord, cap, shaped``: a profile that never rises: the running minimum of ``least(level, ceiling)``, smoothed by a mean that
    shrinks evenly at both ends, and again the running minimum under the cap. ``seed``, a column, bounds a line from above."""
    along = Window.partitionBy(key).orderBy("ord")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    bound = lambda c: F.least(c, F.col(seed)) if seed else c
    rows = vertices.withColumn("cap", F.least("level", "ceiling").cast("double"))
    rows = rows.withColumn("run", bound(F.min("cap").over(so_far)))
    place, many = F.row_number().over(along) - 1, F.count(F.lit(1)).over(Window.partitionBy(key))
    w = F.least(F.lit(radius), place, many - 1 - place)
    mean = F.col("run")
    for k in range(1, radius + 1):
        mean = F.when(F.col("w") >= k, F.avg("run").over(along.rowsBetween(-k, k))).otherwise(mean)
    rows = rows.withColumn("w", w).withColumn("mean", mean)
    return rows.withColumn("shaped", bound(F.min(F.least("mean", "cap")).over(so_far))).select(key, "ord", "cap", "shaped")


def barriers(shaped: DataFrame, *, cut_m: float = 5.0, length_m: float = 40.0, flank_m: float = 1.0, key: str = "seg_id") -> DataFrame:
    """``seg_id, first, crest``: ridges that a shaped profile cuts more than ``cut_m`` deep for more than ``length_m``, outside lakes.

    ``shaped``: ``seg_id, ord`` (from 0)``, cap, shaped, step`` (metres to the next vertex)``, wet``. ``crest`` is the highest capped vertex of the run; ``first``
    is how far up the cut stays over ``flank_m``, but behind the crest of the ridge before.
    """
    along = Window.partitionBy(key).orderBy("ord")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    cut = F.col("cap") - F.col("shaped")
    rows = shaped.withColumn("deep", ~F.col("wet") & F.coalesce(cut > cut_m, F.lit(False))).withColumn("flank", ~F.col("wet") & F.coalesce(cut > flank_m, F.lit(False)))
    # The nearest vertex up to and including this one that is no flank: the flank begins after it.
    rows = rows.withColumn("begin", F.coalesce(F.last(F.when(~F.col("flank"), F.col("ord")), ignorenulls=True).over(so_far) + 1, F.lit(0)))
    fresh = (F.col("deep") & ~F.coalesce(F.lag("deep").over(along), F.lit(False))).cast("int")
    rows = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(so_far)).where("deep")
    runs = rows.groupBy(key, "run").agg(F.sum("step").alias("length"), F.min_by("begin", "ord").alias("begin"), F.max(F.struct("cap", -F.col("ord"))).alias("top"))
    long_ = runs.where(F.col("length") > length_m).select(key, "run", "begin", (-F.col("top.col2")).alias("crest"))
    before = F.lag("crest").over(Window.partitionBy(key).orderBy("run"))
    return long_.withColumn("first", F.greatest("begin", before + 1)).where("first < crest").select(key, "first", "crest")


def pixel_descent(path: DataFrame, tolerance: float = 1e-3, key: str = "seg_id") -> DataFrame:
    """One row: ``steps, rises`` between samples that follow each other on a path, lakes and repeated samples left out. Path: ``seg_id, ord, cell, bed, wet``."""
    along = Window.partitionBy(key).orderBy("ord")
    rows = path.withColumn("same", F.lag("cell").over(along) == F.col("cell")).where("same is null or not same")
    rows = rows.withColumn("rise", F.col("bed") - F.lag("bed").over(along)).withColumn("open", ~F.col("wet") & ~F.lag("wet").over(along)).where("rise is not null and open")
    return rows.agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("rise") > tolerance).alias("rises"))


def fill_gaps(rows: DataFrame, value: str, key: str = "seg_id") -> DataFrame:
    """``rows`` with nulls of ``value`` filled on a straight line between the neighbours that have one, or by the nearest at the ends."""
    along = Window.partitionBy(key).orderBy("ord")
    back, ahead = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(0, Window.unboundedFollowing)
    have = F.when(F.col(value).isNotNull(), F.struct(F.col("ord").alias("o"), F.col(value).cast("double").alias("v")))
    both = rows.withColumn("__a", F.last(have, ignorenulls=True).over(back)).withColumn("__b", F.first(have, ignorenulls=True).over(ahead))
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col("ord") - F.col("__a.o")) / (F.col("__b.o") - F.col("__a.o"))
    filled = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).otherwise(F.coalesce(line, F.col("__a.v"), F.col("__b.v")))
    return both.withColumn(value, filled).drop("__a", "__b")


def running(rows: DataFrame, value: str, width: int, how=F.avg, key: str = "seg_id") -> DataFrame:
    """``rows`` with ``value`` replaced by ``how`` over a centred frame of ``width`` (odd), the ends repeated beyond the line."""
    side = width // 2
    along = Window.partitionBy(key).orderBy("ord")
    whole = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    marked = rows.withColumn("__lo", first).withColumn("__hi", last).withColumn("__i", F.row_number().over(along)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    frame = F.collect_list(value).over(along.rowsBetween(-side, side))
    padded = F.concat(F.array_repeat("__lo", F.greatest(F.lit(0), F.lit(side + 1) - F.col("__i")).cast("int")), frame, F.array_repeat("__hi", F.greatest(F.lit(0), F.lit(side) - F.col("__n") + F.col("__i")).cast("int")))
    ordered = F.array_sort("__w")
    made = {"avg": F.aggregate("__w", F.lit(0.0), lambda a, b: a + b.cast("double")) / width, "median": F.get(ordered, F.lit(side)), "min": F.array_min("__w"), "max": F.array_max("__w")}[how.__name__]
    return marked.withColumn("__w", padded).withColumn(value, made).drop("__lo", "__hi", "__i", "__n", "__w")
