"""River lines: versions, vertices, links, lakes on the way, discharge, and reports on the network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import hydraulics
from tarn.operators.graph import downstream_sums


def dedupe_versions(features: DataFrame, key: str, *newest: str, position: str = "pos") -> DataFrame:
    """One record of each ``key``: the one with the greatest ``newest`` columns (the first among equals), at the first ``position`` of its key."""
    best = F.max_by(F.struct(*(c for c in features.columns if c not in (key, position))), F.struct(*newest, -F.col(position)))
    got = features.groupBy(key).agg(best.alias("b"), F.min(position).alias(position))
    return got.select(*(F.col(c) if c in (key, position) else F.col(f"b.{c}").alias(c) for c in features.columns))


def resolve_fields(available: list[str], wanted: dict[str, tuple[str, ...]]) -> dict[str, str | None]:
    """For each logical field the column that holds it: by exact name, then by folded name, then by a folded part that only one column has."""
    fold = lambda s: "".join(c for c in s.lower() if c.isalnum())
    out: dict[str, str | None] = {}
    for field, names in wanted.items():
        exact = [n for n in names if n in available]
        folded = [a for n in names for a in available if fold(a) == fold(n)]
        parts = [hits[0] for n in names if len(hits := [a for a in available if fold(n) in fold(a)]) == 1]
        out[field] = next(iter([*exact, *folded, *parts]), None)
    return out


def _steps(vertices: DataFrame, key: str = "seg_id") -> DataFrame:
    """Vertices with ``nx, ny`` of the next one on the line."""
    along = Window.partitionBy(key).orderBy("ord")
    return vertices.withColumn("nx", F.lead("x").over(along)).withColumn("ny", F.lead("y").over(along))


def segment_lengths(vertices: DataFrame, key: str = "seg_id") -> DataFrame:
    """``seg_id, length``."""
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    d = F.sqrt(dx * dx + dy * dy)
    return _steps(vertices, key).groupBy(key).agg(F.coalesce(F.sum(d), F.lit(0.0)).alias("length"))


def densify(vertices: DataFrame, stride: float, key: str = "seg_id") -> DataFrame:
    """``seg_id, ord, step, x, y``: vertices so that no piece is longer than ``stride``, in equal parts of each piece; pieces of no length are left out.

    ``ord`` is the vertex a piece starts at, ``step`` the place in it; the first vertex of a line has step 0.
    """
    rows = _steps(vertices, key)
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    d = F.sqrt(dx * dx + dy * dy)
    parts = rows.withColumn("d", d).where("d > 0").withColumn("n", F.ceil(F.col("d") / stride).cast("int"))
    made = parts.withColumn("step", F.explode(F.sequence(F.lit(1), "n")))
    t = F.col("step") / F.col("n")
    between = made.select(key, "ord", "step", (F.col("x") + (F.col("nx") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("ny") - F.col("y")) * t).alias("y"))
    first = rows.withColumn("o", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).where("o = 1")
    return first.select(key, "ord", F.lit(0).alias("step"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).unionByName(between)


def link_ends(segments: DataFrame, tolerance: float) -> DataFrame:
    """``seg_id, downstream``: for each segment's end the segment that starts within ``tolerance``: the highest order, then the smallest id; none: null.

    ``segments``: ``seg_id, order, x0, y0, x1, y1``. Starts are hashed to squares of ``tolerance``; an end looks in its own and the eight around.
    Segments that start at one place stand behind the best two of them (a segment doesn't follow itself), and those that end at one place look once.
    """
    square = lambda c: F.floor(F.col(c) / tolerance)

    def best_two(found: DataFrame, *place: str) -> DataFrame:
        each = found.groupBy(*place, "downstream").agg(F.max("rank").alias("rank"))
        return each.withColumn("n", F.row_number().over(Window.partitionBy(*place).orderBy(F.desc("rank"), "downstream"))).where("n <= 2")

    starts = best_two(segments.select(F.col("seg_id").alias("downstream"), F.col("order").alias("rank"), F.col("x0").alias("sx"), F.col("y0").alias("sy")), "sx", "sy").drop("n")
    starts = starts.withColumns({"bx": square("sx"), "by": square("sy")})
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    ends = segments.select("x1", "y1").distinct().withColumn("w", around).select("x1", "y1", (square("x1") + F.col("w.a")).alias("bx"), (square("y1") + F.col("w.b")).alias("by"))
    dx, dy = F.col("sx") - F.col("x1"), F.col("sy") - F.col("y1")
    near = ends.join(starts.hint("merge"), ["bx", "by"]).where(dx * dx + dy * dy <= tolerance * tolerance)
    best = best_two(near, "x1", "y1").groupBy("x1", "y1").agg(F.max(F.when(F.col("n") == 1, F.col("downstream"))).alias("one"), F.max(F.when(F.col("n") == 2, F.col("downstream"))).alias("two"))
    return segments.select("seg_id", "x1", "y1").join(best.hint("merge"), ["x1", "y1"], "left").select("seg_id", F.when(F.col("one") != F.col("seg_id"), F.col("one")).otherwise(F.col("two")).alias("downstream"))


def mode_order(path: DataFrame, key: str = "seg_id", order: str = "order", fallback: int = 2) -> DataFrame:
    """``seg_id, order``: the most frequent positive order along a path, the smallest among equals; ``fallback`` where there is none."""
    counts = path.where(F.col(order) > 0).groupBy(key, order).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.max(F.struct("n", -F.col(order))).alias("m")).select(key, (-F.col("m.col2")).alias("mode"))
    return path.select(key).distinct().join(best, key, "left").select(key, F.coalesce("mode", F.lit(fallback)).alias("order"))


def lake_spans(path: DataFrame, *, close_gap: int = 2, least: int = 3, key: str = "seg_id") -> DataFrame:
    """``seg_id, a, b, lake_id``: runs of vertices in one lake (``lake_id`` 0: none), first and last vertex; gaps of up to ``close_gap`` vertices within a
    lake are closed, runs of under ``least`` vertices dropped."""
    wet = path.where("lake_id > 0").select(key, "ord", "lake_id")
    along = Window.partitionBy(key).orderBy("ord")
    fresh = F.lag("ord").over(along).isNull() | (F.col("lake_id") != F.lag("lake_id").over(along)) | (F.col("ord") - F.lag("ord").over(along) - 1 > close_gap)
    runs = wet.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    got = runs.groupBy(key, "run").agg(F.min("ord").alias("a"), F.max("ord").alias("b"), F.max("lake_id").alias("lake_id"))
    return got.where(F.col("b") - F.col("a") + 1 >= least).select(key, "a", "b", "lake_id")


def junctions(spans: DataFrame, last: DataFrame) -> DataFrame:
    """``seg_id, lake_id, kind, ord``: where a line enters a lake (``inflow``) and leaves it (``outflow``); ``last``: ``seg_id, n`` vertices."""
    rows = spans.join(last, "seg_id")
    ends = F.array(F.struct(F.lit("inflow").alias("kind"), F.col("a").alias("ord"), (F.col("a") > 0).alias("real")), F.struct(F.lit("outflow").alias("kind"), F.col("b").alias("ord"), (F.col("b") < F.col("n") - 1).alias("real")))
    return rows.withColumn("e", F.explode(ends)).where("e.real").select("seg_id", "lake_id", "e.kind", "e.ord")


def discharge(segments: DataFrame, *, runoff_m: float = 1.0) -> DataFrame:
    """``seg_id, local_m2, total_m2, discharge, width, depth``.

    ``segments``: ``seg_id, downstream, unit, area_km2, length``. The median positive area of a unit's records is dealt out over its segments by length
    (evenly if they have none) and gathered downstream; the members of a cycle share its total.
    """
    unit = Window.partitionBy("unit")
    area = F.median(F.when(F.col("area_km2") > 0, F.col("area_km2"))).over(unit)
    total, many = F.sum("length").over(unit), F.count(F.lit(1)).over(unit)
    share = F.when(total > 0, F.col("length") / total).otherwise(F.lit(1.0) / many)
    local = segments.select("seg_id", "downstream", F.when(F.col("unit").isNotNull(), F.coalesce(area * 1e6 * share, F.lit(0.0))).otherwise(0.0).alias("local_m2"))
    sums = downstream_sums(local.select(F.col("seg_id").alias("node"), F.col("downstream").alias("next"), F.col("local_m2").alias("value")))
    q = F.col("total") * runoff_m / hydraulics.YEAR_S
    out = local.join(sums, F.col("seg_id") == F.col("node")).withColumn("discharge", q)
    return out.select("seg_id", "local_m2", F.col("total").alias("total_m2"), "discharge", hydraulics.width_from_discharge(F.col("discharge")).alias("width"), hydraulics.depth_from_discharge(F.col("discharge")).alias("depth"))


def connectivity(segments: DataFrame) -> DataFrame:
    """One row: ``segments, sinks`` (no downstream)``, sources`` (nothing upstream)``, orphans`` (neither)``, dangling`` (a downstream that isn't there)."""
    ids = segments.select(F.col("seg_id").alias("downstream"), F.lit(True).alias("there")).distinct()
    fed = segments.where("downstream is not null").select(F.col("downstream").alias("seg_id"), F.lit(True).alias("fed")).distinct()
    rows = segments.select("seg_id", "downstream").join(ids, "downstream", "left").join(fed, "seg_id", "left")
    end, alone = F.col("downstream").isNull(), F.col("fed").isNull()
    count = lambda c, n: F.count_if(c).alias(n)
    return rows.agg(F.count(F.lit(1)).alias("segments"), count(end, "sinks"), count(alone, "sources"), count(end & alone, "orphans"), count(~end & F.col("there").isNull(), "dangling"))




def descent_report(vertices: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """One row about steps along lines: ``steps, rises`` over the tolerance``, rises_in_lakes, worst``. Vertices: ``seg_id, ord, z, lake_id``."""
    along = Window.partitionBy("seg_id").orderBy("ord")
    rise = F.col("z") - F.lag("z").over(along)
    rows = vertices.withColumn("rise", rise).withColumn("wet", (F.col("lake_id") > 0) & (F.lag("lake_id").over(along) == F.col("lake_id"))).where("rise is not null")
    up = F.col("rise") > tolerance
    return rows.agg(F.count(F.lit(1)).alias("steps"), F.count_if(up & ~F.col("wet")).alias("rises"), F.count_if(up & F.col("wet")).alias("rises_in_lakes"), F.coalesce(F.max(F.when(up, F.col("rise"))), F.lit(0)).alias("worst"))


def flow_direction_report(vertices: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """One row about whole lines: ``segments, uphill`` (ending over the tolerance above their start)``, uphill_with_lake``."""
    lines = vertices.groupBy("seg_id").agg(F.min_by("z", "ord").alias("first"), F.max_by("z", "ord").alias("last"), F.max((F.col("lake_id") > 0).cast("int")).alias("wet"))
    up = F.col("last") - F.col("first") > tolerance
    return lines.agg(F.count(F.lit(1)).alias("segments"), F.count_if(up & (F.col("wet") == 0)).alias("uphill"), F.count_if(up & (F.col("wet") == 1)).alias("uphill_with_lake"))


def orient(vertices: DataFrame, rise_m: float = 25.0) -> DataFrame:
    """Vertices of lines, those of lake-free lines that climb over ``rise_m`` from end to end in reverse order; ``ord`` runs from 0."""
    lines = vertices.groupBy("seg_id").agg(F.min_by("z", "ord").alias("first"), F.max_by("z", "ord").alias("last"), F.max((F.col("lake_id") > 0).cast("int")).alias("wet"))
    turned = lines.where((F.col("wet") == 0) & (F.col("last") - F.col("first") > rise_m)).select("seg_id", F.lit(-1).alias("way"))
    rows = vertices.join(turned, "seg_id", "left").withColumn("key", F.col("ord") * F.coalesce("way", F.lit(1)))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("seg_id").orderBy("key")) - 1).select(*vertices.columns)


def merge_surveys(surveys: DataFrame, samples: DataFrame, key: str = "lake_no") -> DataFrame:
    """Surveys with their samples' number and depths, kept where either side has the lake: ``lake_no``, the survey's columns, ``samples, mean_depth, max_depth``. The first non-null of several records of a lake counts, by ``pos``."""
    names = [c for c in surveys.columns if c not in (key, "pos")]
    one = surveys.groupBy(key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in names))
    two = samples.where("depth > 0").groupBy(key).agg(F.count(F.lit(1)).alias("samples"), F.avg("depth").alias("mean_depth"), F.max("depth").alias("max_depth"))
    return one.join(two, key, "full_outer")
