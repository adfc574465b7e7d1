"""Neighbourhood operators: pyramids by 3x3 gathers around every second sample, and shading.

A sample is sent to the one or two parents along an axis that gather it, and parents aggregate. The aggregation is partial
before the exchange, so each level moves about as many rows as it returns. Missing rows are missing data; a null value counts as missing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half(n: int) -> int:
    """Samples along an axis one level up."""
    return (n - 1) // 2 + 1


def _gathers(i: Column, n: int) -> Column:
    """(parent, d) of each time that index ``i`` of an axis of ``n`` samples is gathered, d being its place -1, 0 or 1; edges are gathered again in place of what lies beyond."""
    pair = lambda p, d: F.struct(p.cast("int").alias("p"), F.lit(d).alias("d"))
    even = F.array(pair(i / 2, 0))
    even = F.when(i == 0, F.array(pair(i / 2, -1), pair(i / 2, 0), *([pair(i / 2, 1)] if n == 1 else []))).when(i == n - 1, F.array(pair(i / 2, 0), pair(i / 2, 1))).otherwise(even)
    return F.when(i % 2 == 0, even).otherwise(F.array(pair((i - 1) / 2, 1), pair((i + 1) / 2, -1)))


def _decimated_axis(cells: DataFrame, axis: str, other: str, n: int, value: str) -> DataFrame:
    weight = F.when(F.col("g.d") == 0, 2.0).otherwise(1.0)
    each = cells.where(F.col(value).isNotNull()).select(other, F.explode(_gathers(F.col(axis), n)).alias("g"), F.col(value).cast("double").alias("v"))
    return each.groupBy(F.col(other), F.col("g.p").alias(axis)).agg((F.sum(weight * F.col("v")) / F.sum(weight)).alias(value))


def decimate(cells: DataFrame, sy: int, sx: int, value: str = "h") -> DataFrame:
    """One level up: weights 1, 2, 1 along columns, then rows, over what is there; a parent without any is missing. ``sy`` and ``sx`` are odd."""
    return _decimated_axis(_decimated_axis(cells, "col", "row", sx, value), "row", "col", sy, value).select("row", "col", value)


def pyramid(cells: DataFrame, sy: int, sx: int, levels: int, value: str = "h") -> DataFrame:
    """``level, row, col, value`` of all levels, the given one being 0."""
    out, now = None, cells.select("row", "col", value)
    for level in range(levels):
        own = now.select(F.lit(level).alias("level"), "row", "col", value)
        out = own if out is None else out.unionByName(own)
        if level + 1 < levels:
            now = decimate(now, sy, sx, value)
            sy, sx = half(sy), half(sx)
    return out


def _gathered(cells: DataFrame, sy: int, sx: int, *values: str) -> DataFrame:
    """``values`` of each gathered sample at its parent ``prow, pcol``, with its place ``k`` of the nine, row by row."""
    rows = cells.withColumn("gr", F.explode(_gathers(F.col("row"), sy))).withColumn("gc", F.explode(_gathers(F.col("col"), sx)))
    return rows.select(F.col("gr.p").alias("prow"), F.col("gc.p").alias("pcol"), ((F.col("gr.d") + 1) * 3 + F.col("gc.d") + 1).alias("k"), *values)


def downsample_min(cells: DataFrame, sy: int, sx: int, value: str = "surface") -> DataFrame:
    """One level up of a water surface: the lowest of the nine that have water; none where none has."""
    rows = _gathered(cells.where(F.col(value).isNotNull()), sy, sx, value)
    return rows.groupBy(F.col("prow").alias("row"), F.col("pcol").alias("col")).agg(F.min(value).alias(value))


def downsample_water(cells: DataFrame, sy: int, sx: int, code: str = "code", lake_base: int = 16) -> DataFrame:
    """One level up of water codes: the lake most often gathered (first in order among equals), else river, else ocean, else dry."""
    each = _gathered(cells, sy, sx, code).groupBy("prow", "pcol", code).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"))
    lake = F.when(F.col(code) >= lake_base, F.struct(F.col("n"), -F.col("k"), F.col(code)))
    best = each.groupBy(F.col("prow").alias("row"), F.col("pcol").alias("col")).agg(F.max(lake).alias("lake"), F.max((F.col(code) == 1).cast("int")).alias("river"), F.max((F.col(code) == 2).cast("int")).alias("ocean"))
    return best.select("row", "col", F.coalesce(F.col(f"lake.{code}"), F.when(F.col("river") == 1, 1).when(F.col("ocean") == 1, 2).otherwise(0)).alias(code))


def downsample_label(cells: DataFrame, sy: int, sx: int, code: str = "code", label: str = "label") -> DataFrame:
    """One level up of labels: that of the lowest code of the nine, the lower label among equals."""
    rows = _gathered(cells, sy, sx, code, label).groupBy(F.col("prow").alias("row"), F.col("pcol").alias("col"))
    return rows.agg(F.min(F.struct(code, label)).alias("m")).select("row", "col", F.col(f"m.{label}").alias(label))


def _gradient(value: str, window, n: int, at: str, spacing: float) -> Column:
    before, after, own = F.lag(value).over(window), F.lead(value).over(window), F.col(value)
    return F.when(F.lit(n == 1), 0.0).when(F.col(at) == 0, (after - own) / spacing).when(F.col(at) == n - 1, (own - before) / spacing).otherwise((after - before) / (2 * spacing))


def hillshade(cells: DataFrame, sy: int, sx: int, spacing_m: float, *, azimuth_deg: float = 315.0, altitude_deg: float = 45.0, z_factor: float = 1.0) -> DataFrame:
    """``row, col, shade`` in [0, 1] from central differences; samples without a height have the mean height. Every sample must have a row."""
    mean = cells.agg(F.avg("h")).first()[0] or 0.0
    z = cells.select("row", "col", (F.coalesce(F.col("h").cast("double"), F.lit(float(mean))) * z_factor).alias("z"))
    z = z.withColumn("dx", _gradient("z", Window.partitionBy("row").orderBy("col"), sx, "col", spacing_m))
    z = z.withColumn("dy", _gradient("z", Window.partitionBy("col").orderBy("row"), sy, "row", spacing_m))
    slope, aspect = F.atan(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)), F.atan2(-F.col("dy"), F.col("dx"))
    az, alt = math.radians(360 - azimuth_deg + 90), math.radians(altitude_deg)
    shade = F.cos(slope) * math.sin(alt) + F.sin(slope) * F.cos(F.lit(az) - aspect) * math.cos(alt)
    return z.select("row", "col", F.least(F.greatest(shade, F.lit(0.0)), F.lit(1.0)).alias("shade"))


def neighbours(cells: DataFrame, *values: str, diagonal: bool = True) -> DataFrame:
    """Each cell's values sent to its 8 (or 4) neighbours: ``row, col`` of the receiver, ``dr, dc`` towards the sender, ``values``."""
    steps = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r or c) and (diagonal or not (r and c))]
    way = F.explode(F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in steps)))
    return cells.withColumn("w", way).select((F.col("row") - F.col("w.dr")).alias("row"), (F.col("col") - F.col("w.dc")).alias("col"), "w.dr", "w.dc", *values)


def bilinear(points: DataFrame, cells: DataFrame, sy: int, sx: int, value: str = "h", key: str = "id") -> DataFrame:
    """``key, value`` at fractional ``at_row, at_col``: weights of the four corners, renormalised over those that have a value; null if none has.

    A corner of no weight doesn't count. Points beyond the lattice are clamped to it.
    """
    r = F.least(F.greatest(F.col("at_row"), F.lit(0.0)), F.lit(float(sy - 1)))
    c = F.least(F.greatest(F.col("at_col"), F.lit(0.0)), F.lit(float(sx - 1)))
    r0, c0 = F.least(F.floor(r), F.lit(max(0, sy - 2))), F.least(F.floor(c), F.lit(max(0, sx - 2)))
    fr, fc = r - r0, c - c0
    corners = F.array(*(F.struct((r0 + i).cast("int").alias("row"), (c0 + j).cast("int").alias("col"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w")) for i in (0, 1) for j in (0, 1)))
    each = points.select(key, F.explode(corners).alias("k")).select(key, "k.row", "k.col", "k.w").where("w > 0")
    got = each.join(cells.where(F.col(value).isNotNull()).select("row", "col", F.col(value).cast("double").alias("v")), ["row", "col"])
    found = got.groupBy(key).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias(value))
    return points.select(key).join(found, key, "left")
