"""Lakes on the lattice: their levels from what lies around and in them, their shores, records and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.spatial import grid_components, nearest_within, touching
from tarn.operators.stencil import neighbours


def ring_samples(cells: DataFrame, radius: int = 3) -> DataFrame:
    """Heights outside lakes, each with the lake that is nearest within ``radius`` cells: ``lake_id, h``. Cells have ``lake_id`` 0 outside lakes."""
    dry = cells.where((F.col("lake_id") == 0) & F.col("h").isNotNull()).select("row", "col", "h")
    wet = cells.where("lake_id > 0").select("row", "col", "lake_id")
    return nearest_within(dry, wet, radius, "lake_id").select(F.col("near_lake_id").alias("lake_id"), "h")


def ring_percentiles(cells: DataFrame, shares: dict[str, float], *, radius: int = 3, least: int = 5) -> DataFrame:
    """``lake_id, n`` and a percentile (linear between values) for each name in ``shares``; lakes with fewer than ``least`` samples are left out."""
    got = ring_samples(cells, radius).groupBy("lake_id")
    return got.agg(F.count(F.lit(1)).alias("n"), *(F.percentile("h", p).alias(name) for name, p in shares.items())).where(F.col("n") >= least)


def interior_levels(cells: DataFrame, *, margin_m: float = 0.0, trim: float = 0.01, band: float = 0.25, least: int = 5) -> DataFrame:
    """``lake_id, estimate``: the mean of a lake's heights between two of its percentiles, less a margin; lakes under ``least`` samples are left out."""
    wet = cells.where((F.col("lake_id") > 0) & F.col("h").isNotNull()).select("lake_id", F.col("h").cast("double").alias("h"))
    bounds = wet.groupBy("lake_id").agg(F.count(F.lit(1)).alias("n"), F.percentile("h", trim).alias("lo"), F.percentile("h", band).alias("hi")).where(F.col("n") >= least)
    kept = wet.join(bounds, "lake_id").where("h between lo and hi")
    return kept.groupBy("lake_id").agg((F.avg("h") - margin_m).alias("estimate"))


def level_cascade(lakes: DataFrame, rings: DataFrame, interior: DataFrame, pairs: DataFrame, *, above_shore: float | None = 2.0, above_scan: float | None = 1.0, below_scan: float | None = 0.5, twin: float | None = 0.25, cap: bool = True) -> DataFrame:
    """``lake_id, level, source``: the level of each lake and why.

    ``lakes``: ``lake_id, published`` (null if unknown)``, regulated``; ``rings``: ``p10, p25, p90``; ``interior``: ``estimate``; ``pairs``: touching
    lakes ``a, b``. A published level stays unless it stands too far above the shore, or, for unregulated lakes, above or below what was
    scanned; a lake without one takes the estimate, capped by the shore, or the published level of a touching lake whose estimate is about
    the same. A limit of None turns its rule off.
    """
    off = F.lit(False)
    rows = lakes.join(rings.select("lake_id", "p10", "p25", "p90"), "lake_id", "left").join(interior, "lake_id", "left")
    capped = F.least("estimate", "p25") if cap else F.col("estimate")
    rows = rows.withColumn("est", F.when(F.col("estimate").isNotNull(), capped))
    h = F.col("published").cast("double")
    free = ~F.coalesce("regulated", F.lit(False))
    fallback = F.coalesce("est", *(["p25"] if cap else []), "p90")
    high = (h > F.col("p90") + above_shore) if above_shore is not None else off
    scan_high = free & (h > F.col("p10") + above_scan) & (h > F.col("estimate") + above_scan) if above_scan is not None else off
    scan_low = free & (F.col("est") > h + below_scan) if below_scan is not None else off
    level = F.when(h.isNull(), F.col("est")).when(F.coalesce(high, off), F.least(fallback, h)).when(F.coalesce(scan_high, off), F.col("est")).when(F.coalesce(scan_low, off), F.col("est")).otherwise(h)
    source = (
        F.when(h.isNull() & F.col("est").isNull(), "none").when(h.isNull(), "dtm_interior_low").when(F.coalesce(high, off), "dtm_corrected").when(F.coalesce(scan_high, off), "dtm_corrected").when(F.coalesce(scan_low, off), "dtm_raised").otherwise("nve_hoyde")
    )
    rows = rows.select("lake_id", "estimate", level.alias("level"), source.alias("source"))
    if twin is None:
        return rows.select("lake_id", "level", "source")
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    known = rows.where("source = 'nve_hoyde'").select(F.col("lake_id").alias("b"), F.col("level").alias("near"), F.col("estimate").alias("near_est"))
    guess = rows.where("source = 'dtm_interior_low'").select(F.col("lake_id").alias("a"), F.col("estimate").alias("own"))
    found = both.join(guess, "a").join(known, "b").withColumn("d", F.abs(F.col("own") - F.col("near_est"))).where(F.col("d") <= twin)
    best = found.groupBy(F.col("a").alias("lake_id")).agg(F.min(F.struct("d", "b", "near")).alias("m")).select("lake_id", "m.near")
    out = rows.join(best, "lake_id", "left")
    return out.select("lake_id", F.coalesce("near", "level").alias("level"), F.when(F.col("near").isNotNull(), "nve_neighbour").otherwise(F.col("source")).alias("source"))


def touching_lakes(cells: DataFrame) -> DataFrame:
    return touching(cells.where("lake_id > 0").select("row", "col", "lake_id"), "lake_id")


def snap_to_water(cells: DataFrame, *, radius: int = 2, tolerance: float = 0.35) -> DataFrame:
    """``row, col, lake_id``: land within ``radius`` of a lake, and within ``tolerance`` of the median height of that nearest lake, which joins it. ``kind`` 0 is land."""
    level = cells.where("lake_id > 0 and h is not null").groupBy("lake_id").agg(F.median("h").alias("flown"))
    land = cells.where("kind = 0 and h is not null").select("row", "col", "h")
    near = nearest_within(land, cells.where("lake_id > 0").select("row", "col", "lake_id"), radius, "lake_id").withColumnRenamed("near_lake_id", "lake_id")
    return near.join(level, "lake_id").where(F.abs(F.col("h") - F.col("flown")) <= tolerance).select("row", "col", "lake_id")


def tie_in(cells: DataFrame, levels: DataFrame) -> DataFrame:
    """``row, col, tie``: river samples (``kind`` 1) 4-adjacent to a lake, with the highest level among those lakes; rivers are only ever raised to it."""
    wet = cells.where("lake_id > 0").join(levels.where("level is not null"), "lake_id").select("row", "col", "level")
    sent = neighbours(wet, "level", diagonal=False).groupBy("row", "col").agg(F.max("level").alias("tie"))
    return cells.where("kind = 1").select("row", "col").join(sent, ["row", "col"])


def raise_to(level: Column, tie: Column) -> Column:
    """The higher of the two, either of them where the other is missing."""
    return F.greatest(level, tie)


def shore_level(values: str = "h", shore: float = 0.2, void_below: float = 12.0):
    """Two aggregation steps of a robust low shore level: drop what is over ``void_below`` under the upper quartile, take the ``shore`` percentile of the rest."""

    def run(samples: DataFrame, key: str) -> DataFrame:
        top = samples.groupBy(key).agg(F.percentile(values, 0.75).alias("__top"))
        return samples.join(top, key).where(F.col(values) >= F.col("__top") - void_below).groupBy(key).agg(F.percentile(values, shore).alias("shore"))

    return run


def fill_voids(cells: DataFrame, samples_x: int, *, radius: int = 3, void_below: float = 12.0, shore: float = 0.2) -> DataFrame:
    """``row, col, h``: heights with holes in lakes filled by their body's shore level: samples that are missing or over ``void_below`` under it."""
    wet = cells.where("kind = 2").select("row", "col")
    body = grid_components(wet, samples_x)
    dry = cells.where("kind != 2 and h is not null").select("row", "col", "h")
    ring = nearest_within(dry, body, radius, "comp").select(F.col("near_comp").alias("comp"), "h")
    level = shore_level("h", shore, void_below)(ring, "comp")
    named = cells.join(body.join(level, "comp").select("row", "col", "shore"), ["row", "col"], "left")
    hole = F.col("shore").isNotNull() & (F.col("h").isNull() | (F.col("h") < F.col("shore") - void_below))
    return named.select("row", "col", F.when(hole, F.col("shore")).otherwise(F.col("h")).alias("h"))


def seal(cells: DataFrame, levels: DataFrame, sy: int, sx: int, *, map_edge: bool = True) -> DataFrame:
    """``row, col, bed``: lake beds (``h``) raised to the lake's level where a neighbour of another lake or none is lower than that, or the map ends."""
    wet = cells.where("lake_id > 0").join(levels.where("level is not null"), "lake_id")
    low = neighbours(cells, "h", "lake_id").groupBy("row", "col", "lake_id").agg(F.min("h").alias("low")).withColumnRenamed("lake_id", "other")
    worst = wet.select("row", "col", "lake_id").join(low, ["row", "col"]).where("other != lake_id").groupBy("row", "col").agg(F.min("low").alias("low"))
    end = (F.col("row") == 0) | (F.col("row") == sy - 1) | (F.col("col") == 0) | (F.col("col") == sx - 1) if map_edge else F.lit(False)
    out = wet.join(worst, ["row", "col"], "left")
    return out.select("row", "col", F.when((F.coalesce(F.col("low") < F.col("level"), F.lit(False)) | end) & (F.col("h") < F.col("level")), F.col("level")).otherwise(F.col("h").cast("double")).alias("bed"))


def lake_records(cells: DataFrame) -> DataFrame:
    """``lake_id, samples, row_min, row_max, col_min, col_max`` of each lake."""
    edges = [f(c).alias(f"{c}_{n}") for c in ("row", "col") for n, f in (("min", F.min), ("max", F.max))]
    return cells.where("lake_id > 0").groupBy("lake_id").agg(F.count(F.lit(1)).alias("samples"), *edges)


def lake_runs(cells: DataFrame, samples_x: int) -> DataFrame:
    """``lake_id, first_cell, length``: maximal runs of one lake within a row."""
    wet = cells.where("lake_id > 0").select("row", "col", "lake_id")
    run = F.col("col") - F.row_number().over(Window.partitionBy("row", "lake_id").orderBy("col"))
    got = wet.withColumn("run", run).groupBy("row", "lake_id", "run").agg(F.min("col").alias("at"), F.count(F.lit(1)).alias("length"))
    return got.select("lake_id", (F.col("row").cast("long") * samples_x + F.col("at")).alias("first_cell"), "length")


def lake_label_counts(cells: DataFrame, authored: DataFrame) -> DataFrame:
    """``label, lake_id, n``: cells of authored lakes by label, label 0 left out."""
    return cells.where("label != 0 and label is not null").join(authored.select("lake_id").distinct(), "lake_id", "left_semi").groupBy("label", "lake_id").agg(F.count(F.lit(1)).alias("n"))
