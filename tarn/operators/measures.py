"""Measures of lines and curves: normals, curvature, hashes, overlapping reaches, look-ups between samples, widths, and the calibration sweep."""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarn.functions.hydraulics import shore_profile


def normals(vertices: DataFrame, key: str = "seg_id") -> DataFrame:
    """``seg_id, ord, nx, ny``: the unit normal to the left of the chord between a vertex's neighbours; null where the chord has no length."""
    along = Window.partitionBy(key).orderBy("ord")
    end = lambda f, c: F.coalesce(f(c).over(along), F.col(c))
    rows = vertices.withColumn("dx", end(F.lead, "x") - end(F.lag, "x")).withColumn("dy", end(F.lead, "y") - end(F.lag, "y"))
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return rows.withColumn("n", length).select(key, "ord", F.when(F.col("n") > 0, -F.col("dy") / F.col("n")).alias("nx"), F.when(F.col("n") > 0, F.col("dx") / F.col("n")).alias("ny"))


def curvature(vertices: DataFrame, key: str = "seg_id") -> DataFrame:
    """``seg_id, ord, curvature``: the turn a metre at each vertex, to the left positive; 0 at the ends."""
    along = Window.partitionBy(key).orderBy("ord")
    rows = vertices
    for c in "xy":
        rows = rows.withColumn(f"a{c}", F.col(c) - F.lag(c).over(along)).withColumn(f"b{c}", F.lead(c).over(along) - F.col(c))
    cross, dot = F.col("ax") * F.col("by") - F.col("ay") * F.col("bx"), F.col("ax") * F.col("bx") + F.col("ay") * F.col("by")
    la, lb = (F.sqrt(F.col(f"{k}x") * F.col(f"{k}x") + F.col(f"{k}y") * F.col(f"{k}y")) for k in "ab")
    return rows.withColumn("l", la + lb).withColumn("t", F.atan2(cross, dot)).select(key, "ord", F.coalesce(F.when(F.col("l") > 0, F.lit(2.0) * F.col("t") / F.col("l")), F.lit(0.0)).alias("curvature"))


def geometry_hash(lines: DataFrame, key: str = "seg_id") -> DataFrame:
    """``seg_id, hash``: 128 bits of a line's vertices to the centimetre, in order, as hexadecimal."""

    def digest(points: pd.Series) -> pd.Series:
        return pd.Series([hashlib.blake2b(np.rint(np.array([[p["x"], p["y"]] for p in line], float) * 100).astype("<i8").tobytes(), digest_size=16).hexdigest() for line in points])

    gathered = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))).alias("p"))
    return gathered.select(key, F.pandas_udf(digest, StringType())("p").alias("hash"))


def overlap_groups(intervals: DataFrame, key: str = "reach") -> DataFrame:
    """``id, group``: intervals (``id, reach, lo, hi``) of one reach that overlap, over others too, are one group, counted from 0 along the reach; ones that only touch are apart."""
    order = Window.partitionBy(key).orderBy("lo", "hi", "id")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("lo") >= before), 1).otherwise(0)
    return intervals.withColumn("fresh", fresh).withColumn("group", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).select("id", key, "group")


def curve_values(points: DataFrame, curves: DataFrame, key: str = "label") -> DataFrame:
    """``id, value`` of points (``id, label, z``) on piecewise linear curves (``label, j, at, value``), the ends held. Of several samples at one ``at`` the last counts there and behind, the first is what a line from before ends in.

    Points and samples are ordered together, so no curve is joined with each of its points.
    """
    none = F.lit(None)
    both = curves.select(key, F.col("at").alias("z"), F.lit(0).alias("kind"), F.col("j").cast("long").alias("o"), F.struct(F.col("at").cast("double").alias("at"), F.col("value").cast("double").alias("v")).alias("s"), none.cast("long").alias("id"))
    both = both.unionByName(points.select(key, "z", F.lit(1).alias("kind"), F.col("id").cast("long").alias("o"), none.cast("struct<at:double,v:double>").alias("s"), F.col("id").cast("long").alias("id")))
    order = Window.partitionBy(key).orderBy("z", "kind", "o")
    a = F.last("s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first("s", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumn("a", a).withColumn("b", b).where("kind = 1")
    line = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * ((F.col("z") - F.col("a.at")) / (F.col("b.at") - F.col("a.at")))
    return rows.select("id", F.coalesce(F.when(F.col("a.at") == F.col("z"), F.col("a.v")), line, F.col("a.v"), F.col("b.v")).alias("value"))


def class_widths(vertices: DataFrame) -> DataFrame:
    """``seg_id, ord, width``: what is drawn: the measured polygon width (``measured``) where there is one, else the water's own width held within its class
    (2: up to 3 m, 3: 3 to 15 m), else as it is. Vertices: ``seg_id, ord, width, width_class, measured``."""
    w = F.col("width")
    drawn = F.when(F.col("measured") > 0, F.col("measured")).when(F.col("width_class") == 2, F.least(w, F.lit(3.0))).when(F.col("width_class") == 3, F.least(F.greatest(w, F.lit(3.0)), F.lit(15.0))).otherwise(w)
    return vertices.select("seg_id", "ord", drawn.alias("width"))


def calibration(samples: DataFrame, *, slopes: tuple = (0.7, 0.9, 1.1), curves: tuple = (0.4, 0.6, 0.8), scales: tuple = (0.8, 1.0, 1.2)) -> DataFrame:
    """``k, b, scale, max_error, mean_error, point_error, objective`` of each setting, the best first.

    Samples: ``lake_id, q`` (share of the way from the shore)``, depth, reach`` (greatest depth a full profile gives). A lake's errors are the logarithms of modelled over
    surveyed depth: of its maximum, its mean, and the median over its samples; a setting's are the medians over lakes, that over samples counting twice the others.
    """
    grid = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(b).alias("b"), F.lit(s).alias("scale")) for k, b, s in product(slopes, curves, scales))))

    def depth(k: Column, b: Column) -> Column:
        return (F.lit(1.0) - F.exp(-F.col("q") * k / b)) * b

    each = samples.where("depth > 0 and q > 0").withColumn("g", grid).select("lake_id", "g.k", "g.b", "g.scale", "depth", (depth(F.col("g.k"), F.col("g.b")) * F.col("reach") * F.col("g.scale")).alias("model"))
    lake = each.groupBy("k", "b", "scale", "lake_id").agg(F.abs(F.log(F.max("model") / F.max("depth"))).alias("m1"), F.abs(F.log(F.avg("model") / F.avg("depth"))).alias("m2"), F.median(F.abs(F.log(F.col("model") / F.col("depth")))).alias("m3"))
    got = lake.groupBy("k", "b", "scale").agg(F.median("m1").alias("max_error"), F.median("m2").alias("mean_error"), F.median("m3").alias("point_error"))
    return got.withColumn("objective", F.col("point_error") + F.col("max_error") / 2 + F.col("mean_error") / 2).orderBy("objective", "k", "b", "scale")


__all__ = ["calibration", "class_widths", "curvature", "curve_values", "geometry_hash", "normals", "overlap_groups", "shore_profile"]
