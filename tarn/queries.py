"""The engine's queries on the test tables by name, and the SQL that says what each returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.bindings import lattice, lines, rivers, sql, table
from tarn.functions import codecs, hydraulics
from tarn.operators import audit, beds, flow, hierarchy, lakes, measures, paths, profiles, shores, spatial, stencil
from tarn.operators import rivers as river_ops
from tarn.plans.lattice import GridPlan
from tarn.sources import features

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _range(cells: DataFrame) -> tuple:
    low, high = cells.agg(F.min("h"), F.max("h")).first()
    return F.lit(float(low or 0)), F.lit(float(high or 1))


_SHARE = "greatest(0, least(1, (h - lo)::DOUBLE / greatest(hi - lo, 1e-6)))"


@query(sql(f", r AS (SELECT min(h) AS lo, max(h) AS hi FROM cells) SELECT row, col, round_even({_SHARE} * 65535, 0)::INTEGER AS code FROM cells, r", "cells"))
def pack_height_codes(spark, sf_dir):
    cells, _, _ = lattice(spark, sf_dir)
    return cells.select("row", "col", codecs.pack_height(F.col("h"), *_range(cells)).alias("code"))


@query(
    sql(
        f""", r AS (SELECT min(h) AS lo, max(h) AS hi FROM cells), p AS (SELECT row, col, lo, hi, CASE WHEN kind = 0 THEN 65535 ELSE round_even({_SHARE} * 65534, 0)::INTEGER END AS packed FROM cells, r)
    SELECT row, col, packed, coalesce(round((lo + packed / 65534.0::DOUBLE * (hi - lo)))::BIGINT, -1) AS surface FROM (SELECT row, col, packed, lo, CASE WHEN packed <> 65535 THEN hi END AS hi FROM p)""",
        "cells",
    )
)
def pack_surface_codes(spark, sf_dir):
    cells, _, _ = lattice(spark, sf_dir)
    low, high = _range(cells)
    packed = cells.select("row", "col", codecs.pack_surface(F.when(F.col("kind") > 0, F.col("h")), low, high).alias("packed"))
    return packed.withColumn("surface", F.coalesce(F.round(codecs.unpack_surface(F.col("packed"), low, high)).cast("long"), F.lit(-1)))


_CODE = "CASE WHEN kind = 2 THEN lake_id + 16 WHEN kind = 1 THEN 1 WHEN h < 5000000 THEN 2 ELSE 0 END"


def _coded(spark, sf_dir):
    cells, sy, sx = lattice(spark, sf_dir)
    return cells.withColumn("code", codecs.water_code(F.col("kind"), F.col("lake_id"), F.col("h") < 5000000)), sy, sx


@query(sql(f", c AS (SELECT row, col, {_CODE} AS code FROM cells) SELECT row, col, code, CASE WHEN code >= 16 THEN 1 WHEN code = 1 THEN 2 WHEN code = 2 THEN 3 ELSE 0 END AS class, CASE WHEN code >= 16 THEN code - 16 ELSE 0 END AS lake FROM c", "cells"))
def water_id_codes(spark, sf_dir):
    cells, _, _ = _coded(spark, sf_dir)
    return cells.select("row", "col", "code", codecs.water_class(F.col("code")).alias("class"), codecs.water_lake_id(F.col("code")).alias("lake"))


PLAN = GridPlan(25833, 5.0, 0.0, 0.0, 64, 8, 4, 3)


@query(
    """WITH l AS (SELECT unnest(range(0, 3))::INTEGER AS level), t AS (SELECT level, greatest(1, 8 >> level) AS tx, greatest(1, 4 >> level) AS ty FROM l),
    b AS (SELECT *, coalesce(sum(tx * ty) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 65 * 65 * 2 AS base FROM t),
    x AS (SELECT *, unnest(range(0, tx))::INTEGER AS x FROM b), y AS (SELECT *, unnest(range(0, ty))::INTEGER AS y FROM x)
    SELECT level, x, y, (base + (y * tx + x) * 65 * 65 * 2)::BIGINT AS byte_offset FROM y"""
)
def tile_offsets(spark, sf_dir):
    levels = spark.range(PLAN.num_levels).select(F.col("id").cast("int").alias("level"))
    many = lambda n: F.greatest(F.lit(1), F.call_function("shiftright", F.lit(n), F.col("level")))
    sized = levels.withColumn("tx", many(PLAN.leaf_tiles_x)).withColumn("ty", many(PLAN.leaf_tiles_y))
    base = F.coalesce(F.sum(F.col("tx") * F.col("ty")).over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * PLAN.tile_bytes(2)
    rows = sized.withColumn("base", base).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("tx") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("ty") - 1)))
    return rows.select("level", "x", "y", (F.col("base") + (F.col("y") * F.col("tx") + F.col("x")) * PLAN.tile_bytes(2)).alias("byte_offset"))


@query(
    sql(
        """, t AS (SELECT *, unnest(CASE WHEN col % 16 = 0 AND col > 0 THEN [col // 16 - 1, col // 16] ELSE [col // 16] END) AS tx,
           CASE WHEN row % 16 = 0 AND row > 0 THEN [row // 16 - 1, row // 16] ELSE [row // 16] END AS tys FROM cells), u AS (SELECT *, unnest(tys) AS ty FROM t)
        SELECT tx::INTEGER AS tx, ty::INTEGER AS ty, count(*) AS samples, sum(h)::BIGINT AS total FROM u, dim WHERE tx < (sx - 1) // 16 GROUP BY tx, ty""",
        "dim",
        "cells",
    )
)
def tile_samples(spark, sf_dir):
    cells, _, sx = lattice(spark, sf_dir)
    of = lambda c: F.when((c % 16 == 0) & (c > 0), F.array(F.floor(c / 16).cast("int") - 1, F.floor(c / 16).cast("int"))).otherwise(F.array(F.floor(c / 16).cast("int")))
    tiles = cells.withColumn("tx", F.explode(of(F.col("col")))).withColumn("ty", F.explode(of(F.col("row")))).where(F.col("tx") < (sx - 1) // 16)
    return tiles.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("samples"), F.sum("h").alias("total"))


#: Parents and places of the children of an axis, for SQL: the three places of each parent, clamped.
_PARENTS = """, pr AS (SELECT unnest(range(0, (sy - 1) // 2 + 1))::INTEGER AS prow, sy, sx FROM dim), pc AS (SELECT unnest(range(0, (sx - 1) // 2 + 1))::INTEGER AS pcol FROM dim),
    d AS (SELECT unnest([-1, 0, 1]) AS d),
    gr AS (SELECT prow, d.d AS dr, least(greatest(2 * prow + d.d, 0), sy - 1) AS row FROM pr, d), gc AS (SELECT pcol, d.d AS dc, least(greatest(2 * pcol + d.d, 0), (SELECT sx FROM dim) - 1) AS col FROM pc, d)"""


@query(
    sql(
        _PARENTS
        + """, h1 AS (SELECT row, pcol, sum(h * (2 - abs(dc)))::DOUBLE / sum(2 - abs(dc)) AS v FROM cells JOIN gc USING (col) GROUP BY row, pcol)
    SELECT prow AS row, pcol AS col, sum(v * (2 - abs(dr))) / sum(2 - abs(dr)) AS h FROM h1 JOIN gr USING (row) GROUP BY prow, pcol""",
        "dim",
        "cells",
    )
)
def decimate_height(spark, sf_dir):
    return stencil.decimate(*lattice(spark, sf_dir))


@query(sql(_PARENTS + " SELECT prow AS row, pcol AS col, min(h) AS surface FROM cells JOIN gc USING (col) JOIN gr USING (row) WHERE kind > 0 GROUP BY prow, pcol", "dim", "cells"))
def downsample_surface_min(spark, sf_dir):
    cells, sy, sx = lattice(spark, sf_dir)
    return stencil.downsample_min(cells.where("kind > 0").withColumn("surface", F.col("h")), sy, sx)


@query(
    sql(
        _PARENTS
        + f""", g AS (SELECT prow, pcol, {_CODE} AS code, (dr + 1) * 3 + dc + 1 AS k FROM cells JOIN gc USING (col) JOIN gr USING (row)),
        n AS (SELECT prow, pcol, code, count(*) AS n, min(k) AS k FROM g GROUP BY ALL),
        best AS (SELECT prow, pcol, code FROM n WHERE code >= 16 QUALIFY row_number() OVER (PARTITION BY prow, pcol ORDER BY n DESC, k) = 1)
    SELECT n.prow AS row, n.pcol AS col, coalesce(max(best.code), CASE WHEN bool_or(n.code = 1) THEN 1 WHEN bool_or(n.code = 2) THEN 2 ELSE 0 END)::INTEGER AS code
    FROM n LEFT JOIN best ON n.prow = best.prow AND n.pcol = best.pcol GROUP BY n.prow, n.pcol""",
        "dim",
        "cells",
    )
)
def downsample_water_id(spark, sf_dir):
    return stencil.downsample_water(*_coded(spark, sf_dir))


@query(sql(_PARENTS + " SELECT prow AS row, pcol AS col, (min(code * 100000000 + cell) % 100000000)::BIGINT AS label FROM cells JOIN gc USING (col) JOIN gr USING (row) GROUP BY prow, pcol", "dim", "cells"))
def downsample_labels(spark, sf_dir):
    cells, sy, sx = lattice(spark, sf_dir)
    return stencil.downsample_label(cells.withColumn("label", F.col("cell")), sy, sx)


@query(
    sql(
        """, m AS (SELECT avg(h)::DOUBLE AS m FROM cells), f AS (SELECT r.row, c.col, coalesce(h::DOUBLE, m) AS z FROM (SELECT unnest(range(0, sy))::INTEGER AS row FROM dim) r
        CROSS JOIN (SELECT unnest(range(0, 65))::INTEGER AS col) c CROSS JOIN m LEFT JOIN cells ON cells.row = r.row AND cells.col = c.col),
        g AS (SELECT f.row, f.col, CASE WHEN f.col = 0 THEN (lead(z) OVER a - z) / 50000 WHEN f.col = 64 THEN (z - lag(z) OVER a) / 50000 ELSE (lead(z) OVER a - lag(z) OVER a) / 100000 END AS dx,
        CASE WHEN f.row = 0 THEN (lead(z) OVER b - z) / 50000 WHEN f.row = sy - 1 THEN (z - lag(z) OVER b) / 50000 ELSE (lead(z) OVER b - lag(z) OVER b) / 100000 END AS dy
        FROM f, dim WINDOW a AS (PARTITION BY f.row ORDER BY f.col), b AS (PARTITION BY f.col ORDER BY f.row))
    SELECT row, col, round(least(greatest(sin(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy))) + cos(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(135) - atan2(-dy, dx)), 0), 1), 6) AS shade FROM g""",
        "dim",
        "cells",
    )
)
def hillshade(spark, sf_dir):
    cells, sy, sx = lattice(spark, sf_dir)
    every = spark.range(sy * sx).select(F.floor(F.col("id") / sx).cast("int").alias("row"), (F.col("id") % sx).cast("int").alias("col"))
    full = every.join(cells.select("row", "col", "h"), ["row", "col"], "left")
    return stencil.hillshade(full, sy, sx, 50000.0).select("row", "col", F.round("shade", 6).alias("shade"))


@query(
    sql(
        """, p AS (SELECT cell AS id, row + 0.25 AS r, col * 0.5 + 0.5 AS c FROM cells), k AS (SELECT id, r, c, unnest([0, 1]) AS i FROM p), q AS (SELECT *, unnest([0, 1]) AS j FROM k),
        w AS (SELECT id, least(floor(least(r, sy - 1)), sy - 2)::INTEGER + i AS row, least(floor(least(c, sx - 1)), sx - 2)::INTEGER + j AS col,
        (CASE WHEN i = 1 THEN least(r, sy - 1) - least(floor(least(r, sy - 1)), sy - 2) ELSE 1 - (least(r, sy - 1) - least(floor(least(r, sy - 1)), sy - 2)) END)::DOUBLE *
        (CASE WHEN j = 1 THEN least(c, sx - 1) - least(floor(least(c, sx - 1)), sx - 2) ELSE 1 - (least(c, sx - 1) - least(floor(least(c, sx - 1)), sx - 2)) END)::DOUBLE AS w FROM q, dim)
    SELECT id, sum(w * h) / sum(w) AS h FROM w JOIN cells USING (row, col) WHERE w > 0 GROUP BY id""",
        "dim",
        "cells",
    )
)
def bilinear_samples(spark, sf_dir):
    cells, sy, sx = lattice(spark, sf_dir)
    points = cells.select(F.col("cell").alias("id"), (F.col("row") + 0.25).alias("at_row"), (F.col("col") * 0.5 + 0.5).alias("at_col"))
    return stencil.bilinear(points, cells, sy, sx).where("h is not null")


@query(sql(" SELECT count(*) AS samples, min(h) AS low, max(h) AS high, (sum(h) // count(*))::BIGINT AS mean, (max(sx) * max(sy) - count(*))::BIGINT AS missing FROM cells, dim", "dim", "cells"))
def height_stats(spark, sf_dir):
    cells, sy, sx = lattice(spark, sf_dir)
    return cells.agg(F.count("h").alias("samples"), F.min("h").alias("low"), F.max("h").alias("high"), F.expr("sum(h) div count(h)").alias("mean"), (F.lit(sy * sx).cast("long") - F.count("h")).alias("missing"))


@query("SELECT user_id, event_type, event_id, value, pos FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS pos, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def dedupe_latest_version(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("key", F.struct("user_id", "event_type")).withColumn("pos", F.col("event_id"))
    got = river_ops.dedupe_versions(events.select("key", "ts", "event_id", "value", "pos"), "key", "ts", "event_id")
    return got.select("key.user_id", "key.event_type", "event_id", "value", "pos")


@query("""SELECT event_id, least(greatest(coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 2), 1), 255)::INTEGER AS "order", lower(event_type) || '_' || coalesce(json_extract_string(props, '$.k'), '') AS name FROM events""")
def parse_properties(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    order = F.least(F.greatest(F.coalesce(k.try_cast("int"), F.lit(2)), F.lit(1)), F.lit(255))
    return table(spark, sf_dir, "events").select("event_id", order.alias("order"), F.concat(F.lower("event_type"), F.lit("_"), F.coalesce(k, F.lit(""))).alias("name"))


@query(
    sql(
        """, s AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM lines WINDOW w AS (PARTITION BY seg_id ORDER BY ord)),
        p AS (SELECT *, ceil(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) / 2.0)::INTEGER AS n FROM s WHERE nx IS NOT NULL AND sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) > 0),
        e AS (SELECT *, unnest(range(1, n + 1))::INTEGER AS step FROM p)
    SELECT seg_id, ord, 0 AS step, x, y FROM lines WHERE ord = 0 UNION ALL SELECT seg_id, ord, step, x + (nx - x) * (step / n), y + (ny - y) * (step / n) FROM e""",
        "lines",
    )
)
def densify(spark, sf_dir):
    return river_ops.densify(lines(spark, sf_dir), 2.0)


@query(sql(" SELECT seg_id, round(coalesce(sum(d), 0), 4) AS length FROM (SELECT seg_id, sqrt((lead(x) OVER w - x) ^ 2 + (lead(y) OVER w - y) ^ 2) AS d FROM lines WINDOW w AS (PARTITION BY seg_id ORDER BY ord)) GROUP BY seg_id", "lines"))
def polyline_lengths(spark, sf_dir):
    return river_ops.segment_lengths(lines(spark, sf_dir)).select("seg_id", F.round("length", 4).alias("length"))


@query(
    sql(
        """ SELECT a.seg_id, coalesce(b.seg_id, -1) AS downstream FROM rivers a LEFT JOIN rivers b ON a.seg_id <> b.seg_id AND (b.x0 - a.x1) * (b.x0 - a.x1) + (b.y0 - a.y1) * (b.y0 - a.y1) <= 4
    QUALIFY row_number() OVER (PARTITION BY a.seg_id ORDER BY b."order" DESC, b.seg_id) = 1""",
        "rivers",
    )
)
def link_endpoints(spark, sf_dir):
    return river_ops.link_ends(rivers(spark, sf_dir), 2.0).select("seg_id", F.coalesce("downstream", F.lit(-1)).alias("downstream"))


@query("""SELECT o_custkey AS seg_id, coalesce((SELECT 1), 1) * coalesce(m, 2)::INTEGER AS "order" FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN (SELECT o_custkey, (o_orderkey % 5)::INTEGER AS m FROM orders WHERE o_orderkey % 5 > 0 GROUP BY o_custkey, o_orderkey % 5 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderkey % 5) = 1) USING (o_custkey)""")
def path_mode_order(spark, sf_dir):
    path = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("seg_id"), (F.col("o_orderkey") % 5).cast("int").alias("order"))
    return river_ops.mode_order(path)


_SPANS = """, wet AS (SELECT row AS seg_id, col AS ord, lake_id FROM cells WHERE lake_id > 0),
    f AS (SELECT *, CASE WHEN lag(ord) OVER w IS NULL OR lag(lake_id) OVER w <> lake_id OR ord - lag(ord) OVER w - 1 > 2 THEN 1 ELSE 0 END AS fresh FROM wet WINDOW w AS (PARTITION BY seg_id ORDER BY ord)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY seg_id ORDER BY ord) AS run FROM f),
    spans AS (SELECT seg_id, min(ord) AS a, max(ord) AS b, max(lake_id) AS lake_id FROM r GROUP BY seg_id, run HAVING max(ord) - min(ord) + 1 >= 2)"""


def _spans(spark, sf_dir):
    cells, _, _ = lattice(spark, sf_dir)
    path = cells.select(F.col("row").alias("seg_id"), F.col("col").alias("ord"), "lake_id")
    return river_ops.lake_spans(path, least=2), path


@query(sql(_SPANS + " SELECT * FROM spans", "cells"))
def lake_spans(spark, sf_dir):
    return _spans(spark, sf_dir)[0]


@query(sql(_SPANS + ", n AS (SELECT row AS seg_id, count(*) AS n FROM cells GROUP BY row) SELECT seg_id, lake_id, 'inflow' AS kind, a AS ord FROM spans WHERE a > 0 UNION ALL SELECT seg_id, lake_id, 'outflow', b FROM spans JOIN n USING (seg_id) WHERE b < n - 1", "cells"))
def junctions(spark, sf_dir):
    spans, path = _spans(spark, sf_dir)
    return river_ops.junctions(spans, path.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n")))


@query(sql(" SELECT lake_id, count(*) AS samples, min(row) AS row_min, max(row) AS row_max, min(col) AS col_min, max(col) AS col_max FROM cells WHERE lake_id > 0 GROUP BY lake_id", "cells"))
def lake_records(spark, sf_dir):
    return lakes.lake_records(lattice(spark, sf_dir)[0])


@query(sql(" SELECT lake_id, (row::BIGINT * 65 + min(col))::BIGINT AS first_cell, count(*) AS length FROM (SELECT row, col, lake_id, col - row_number() OVER (PARTITION BY row, lake_id ORDER BY col) AS run FROM cells WHERE lake_id > 0) GROUP BY row, lake_id, run", "cells"))
def lake_cell_runs(spark, sf_dir):
    cells, _, sx = lattice(spark, sf_dir)
    return lakes.lake_runs(cells, sx)


@query(sql(" SELECT code AS label, lake_id, count(*) AS n FROM cells WHERE code <> 0 AND lake_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY code, lake_id", "cells"))
def lake_label_counts(spark, sf_dir):
    cells, _, _ = lattice(spark, sf_dir)
    authored = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("lake_id"))
    return lakes.lake_label_counts(cells.withColumn("label", F.col("code")), authored)


_PAIRS = "SELECT DISTINCT least(a.lake_id, b.lake_id) AS a, greatest(a.lake_id, b.lake_id) AS b FROM cells a JOIN cells b ON b.row - a.row BETWEEN -1 AND 1 AND b.col - a.col BETWEEN -1 AND 1 AND a.lake_id > 0 AND b.lake_id > 0 AND a.lake_id <> b.lake_id"
_NEAR_STEPS = ", st AS (SELECT r, c FROM (SELECT unnest([-3,-2,-1,0,1,2,3]) AS r), (SELECT unnest([-3,-2,-1,0,1,2,3]) AS c) WHERE r * r + c * c <= 9)"
_ADJ = ", s8 AS (SELECT r, c FROM (SELECT unnest([-1, 0, 1]) AS r), (SELECT unnest([-1, 0, 1]) AS c) WHERE r <> 0 OR c <> 0)"


@query(sql(_ADJ + " SELECT DISTINCT least(a.lake_id, b.lake_id) AS a, greatest(a.lake_id, b.lake_id) AS b FROM cells a, s8 JOIN cells b ON b.row = a.row + r AND b.col = a.col + c WHERE a.lake_id > 0 AND b.lake_id > 0 AND a.lake_id <> b.lake_id", "cells"))
def touching_lakes(spark, sf_dir):
    return lakes.touching_lakes(lattice(spark, sf_dir)[0])


_INTERIOR = ", b AS (SELECT lake_id, quantile_cont(h::DOUBLE, 0.01) AS lo, quantile_cont(h::DOUBLE, 0.25) AS hi FROM cells WHERE lake_id > 0 GROUP BY lake_id HAVING count(*) >= 5), interior AS (SELECT lake_id, round(sum(h)::DOUBLE / count(*), 3) AS estimate FROM cells JOIN b USING (lake_id) WHERE h BETWEEN lo AND hi GROUP BY lake_id)"
_RING = (
    _NEAR_STEPS
    + """, nr AS (SELECT d.row, d.col, d.h, arg_min(l.lake_id, (r * r + c * c) * 100000000000::BIGINT + l.row::BIGINT * 1000 + l.col) AS lake_id FROM cells d, st JOIN cells l ON l.row = d.row + r AND l.col = d.col + c
    WHERE d.lake_id = 0 AND l.lake_id > 0 GROUP BY d.row, d.col, d.h),
    rings AS (SELECT lake_id, count(*) AS n, quantile_cont(h::DOUBLE, 0.1) AS p10, quantile_cont(h::DOUBLE, 0.25) AS p25, quantile_cont(h::DOUBLE, 0.9) AS p90 FROM nr GROUP BY lake_id HAVING count(*) >= 5)"""
)
_SHARES = {"p10": 0.1, "p25": 0.25, "p90": 0.9}


@query(sql(_INTERIOR + " SELECT * FROM interior", "cells"))
def interior_levels(spark, sf_dir):
    return lakes.interior_levels(lattice(spark, sf_dir)[0]).select("lake_id", F.round("estimate", 3).alias("estimate"))


@query(sql(_RING + " SELECT lake_id, n, round(p10, 3) AS p10, round(p25, 3) AS p25, round(p90, 3) AS p90 FROM rings", "cells"))
def ring_percentiles(spark, sf_dir):
    got = lakes.ring_percentiles(lattice(spark, sf_dir)[0], _SHARES)
    return got.select("lake_id", "n", *(F.round(c, 3).alias(c) for c in _SHARES))


@query(
    sql(
        _RING
        + _INTERIOR
        + _ADJ
        + """, pairs AS (SELECT DISTINCT a.lake_id AS a, b.lake_id AS b FROM cells a, s8 JOIN cells b ON b.row = a.row + r AND b.col = a.col + c WHERE a.lake_id > 0 AND b.lake_id > 0 AND a.lake_id <> b.lake_id),
        lk AS (SELECT n_nationkey AS lake_id, CASE WHEN n_regionkey <> 1 THEN n_nationkey * 7000000::DOUBLE END AS published, n_regionkey = 0 AS regulated FROM nation WHERE n_nationkey BETWEEN 1 AND 7),
        j AS (SELECT lk.*, p10, p25, p90, estimate, CASE WHEN estimate IS NOT NULL THEN least(estimate, p25) END AS est FROM lk LEFT JOIN rings USING (lake_id) LEFT JOIN interior USING (lake_id)),
        s AS (SELECT *, CASE WHEN published IS NULL THEN CASE WHEN est IS NULL THEN 'none' ELSE 'dtm_interior_low' END WHEN published > p90 + 200 THEN 'dtm_corrected'
              WHEN NOT regulated AND published > p10 + 100 AND published > estimate + 100 THEN 'dtm_corrected' WHEN NOT regulated AND est > published + 50 THEN 'dtm_raised' ELSE 'nve_hoyde' END AS source FROM j),
        v AS (SELECT *, CASE WHEN published IS NULL THEN est WHEN published > p90 + 200 THEN least(coalesce(est, p25, p90), published) WHEN source IN ('dtm_corrected', 'dtm_raised') THEN est ELSE published END AS level FROM s),
        tw AS (SELECT x.lake_id, arg_min(y.level, abs(x.estimate - y.estimate) * 1000 + y.lake_id) AS near FROM v x JOIN pairs ON pairs.a = x.lake_id JOIN v y ON y.lake_id = pairs.b
               WHERE x.source = 'dtm_interior_low' AND y.source = 'nve_hoyde' AND abs(x.estimate - y.estimate) <= 500000 GROUP BY x.lake_id)
    SELECT lake_id, round(coalesce(near, level), 3) AS level, CASE WHEN near IS NOT NULL THEN 'nve_neighbour' ELSE source END AS source FROM v LEFT JOIN tw USING (lake_id)""",
        "cells",
    )
)
def level_cascade(spark, sf_dir):
    cells, _, _ = lattice(spark, sf_dir)
    known = F.when(F.col("n_regionkey") != 1, F.col("n_nationkey") * 7000000.0)
    lake = table(spark, sf_dir, "nation").where("n_nationkey between 1 and 7").select(F.col("n_nationkey").alias("lake_id"), known.alias("published"), (F.col("n_regionkey") == 0).alias("regulated"))
    interior = lakes.interior_levels(cells).select("lake_id", F.round("estimate", 3).alias("estimate"))
    got = lakes.level_cascade(lake, lakes.ring_percentiles(cells, _SHARES), interior, lakes.touching_lakes(cells), above_shore=200, above_scan=100, below_scan=50, twin=500000)
    return got.select("lake_id", F.round("level", 3).alias("level"), "source")


@query(
    sql(
        _NEAR_STEPS
        + """, m AS (SELECT lake_id, median(h::DOUBLE) AS flown FROM cells WHERE lake_id > 0 GROUP BY lake_id),
        nr AS (SELECT d.row, d.col, d.h, arg_min(l.lake_id, (r * r + c * c) * 100000000000::BIGINT + l.row::BIGINT * 1000 + l.col) AS lake_id FROM cells d, st JOIN cells l ON l.row = d.row + r AND l.col = d.col + c
        WHERE d.kind = 0 AND l.lake_id > 0 AND r * r + c * c <= 4 GROUP BY d.row, d.col, d.h)
    SELECT row, col, lake_id FROM nr JOIN m USING (lake_id) WHERE abs(h - flown) <= 3000000""",
        "cells",
    )
)
def shore_snap(spark, sf_dir):
    return lakes.snap_to_water(lattice(spark, sf_dir)[0], tolerance=3000000)


_LEVELS = ", lv AS (SELECT lake_id, avg(h)::BIGINT AS level FROM cells WHERE lake_id > 0 GROUP BY lake_id)"


def _levels(cells: DataFrame) -> DataFrame:
    return cells.where("lake_id > 0").groupBy("lake_id").agg(F.expr("sum(h) div count(h)").alias("level"))


@query(sql(_LEVELS.replace("avg(h)::BIGINT", "(sum(h) // count(*))::BIGINT") + " SELECT d.row, d.col, max(level) AS tie FROM cells d, (SELECT unnest([-1, 1, 0, 0]) AS r, unnest([0, 0, -1, 1]) AS c) JOIN cells l ON l.row = d.row + r AND l.col = d.col + c JOIN lv ON lv.lake_id = l.lake_id WHERE d.kind = 1 GROUP BY d.row, d.col", "cells"))
def lake_tie_in(spark, sf_dir):
    cells, _, _ = lattice(spark, sf_dir)
    return lakes.tie_in(cells, _levels(cells))


@query(
    sql(
        _LEVELS.replace("avg(h)::BIGINT", "(sum(h) // count(*))::BIGINT")
        + _ADJ
        + """, low AS (SELECT w.row, w.col, min(o.h) AS low FROM cells w, s8 JOIN cells o ON o.row = w.row + r AND o.col = w.col + c WHERE w.lake_id > 0 AND o.lake_id <> w.lake_id GROUP BY w.row, w.col)
    SELECT cells.row, cells.col, (CASE WHEN (coalesce(low < level, false) OR cells.row IN (0, sy - 1) OR cells.col IN (0, sx - 1)) AND h < level THEN level ELSE h END)::DOUBLE AS bed
    FROM cells JOIN lv USING (lake_id) LEFT JOIN low ON low.row = cells.row AND low.col = cells.col CROSS JOIN dim""",
        "dim",
        "cells",
    )
)
def seal_shores(spark, sf_dir):
    cells, sy, sx = lattice(spark, sf_dir)
    return lakes.seal(cells, _levels(cells), sy, sx).select("row", "col", F.col("bed").cast("double").alias("bed"))


@query(
    """SELECT coalesce(p_partkey, l_partkey) AS lake_no, coalesce(p_name, '') AS name, coalesce(p_size, 0) AS size, coalesce(samples, 0) AS samples, coalesce(round(total / samples, 3), 0) AS mean_depth, coalesce(max_depth, 0) AS max_depth
    FROM part FULL JOIN (SELECT l_partkey, count(*) AS samples, sum(l_quantity::BIGINT) AS total, max(l_quantity) AS max_depth FROM lineitem WHERE l_quantity > 0 GROUP BY l_partkey) ON p_partkey = l_partkey"""
)
def survey_merge(spark, sf_dir):
    surveys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lake_no"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.lit(0).alias("pos"))
    samples = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("lake_no"), F.col("l_quantity").alias("depth"))
    got = river_ops.merge_surveys(surveys, samples)
    return got.select("lake_no", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("samples", F.lit(0)).alias("samples"), F.round(F.coalesce("mean_depth", F.lit(0.0)), 3).alias("mean_depth"), F.coalesce("max_depth", F.lit(0.0)).alias("max_depth"))


@query(
    sql(
        """, u AS (SELECT *, median(CASE WHEN area_km2 > 0 THEN area_km2 END) OVER (PARTITION BY unit) AS area, sum(length) OVER (PARTITION BY unit) AS total FROM rivers),
        l AS (SELECT seg_id, downstream, coalesce(area * 1e6::DOUBLE * (length / total), 0) AS local FROM u),
        up(seg_id, place) AS (SELECT seg_id, seg_id FROM l UNION ALL SELECT up.seg_id, l.downstream FROM up JOIN l ON l.seg_id = up.place WHERE l.downstream IS NOT NULL),
        t AS (SELECT place AS seg_id, sum(local) AS total_m2 FROM up JOIN l USING (seg_id) GROUP BY place)
    SELECT seg_id, round(local)::BIGINT AS local_m2, round(total_m2 / 1000)::BIGINT AS total_1000_m2, round(least(greatest(8 * sqrt(total_m2 / 31557600), 2), 80), 3) AS width,
           round(least(greatest(2 * (total_m2 / 31557600) ^ 0.3, 0.5), 5), 3) AS depth FROM l JOIN t USING (seg_id)""",
        "rivers",
    )
)
def discharge_width_depth(spark, sf_dir):
    got = river_ops.discharge(rivers(spark, sf_dir))
    return got.select("seg_id", F.round("local_m2").cast("long").alias("local_m2"), F.round(F.col("total_m2") / 1000).cast("long").alias("total_1000_m2"), F.round("width", 3).alias("width"), F.round("depth", 3).alias("depth"))


@query(sql(" SELECT count(*) AS segments, count(*) FILTER (downstream IS NULL) AS sinks, count(*) FILTER (seg_id NOT IN (SELECT downstream FROM rivers WHERE downstream IS NOT NULL)) AS sources, count(*) FILTER (downstream IS NULL AND seg_id NOT IN (SELECT downstream FROM rivers WHERE downstream IS NOT NULL)) AS orphans, count(*) FILTER (downstream IS NOT NULL AND downstream NOT IN (SELECT seg_id FROM rivers)) AS dangling FROM rivers", "rivers"))
def network_connectivity(spark, sf_dir):
    return river_ops.connectivity(rivers(spark, sf_dir))


@query(sql(", s AS (SELECT z - lag(z) OVER w AS rise, lake_id > 0 AND lag(lake_id) OVER w = lake_id AS wet FROM lines WINDOW w AS (PARTITION BY seg_id ORDER BY ord)) SELECT count(*) AS steps, count(*) FILTER (rise > 5 AND NOT wet) AS rises, count(*) FILTER (rise > 5 AND wet) AS rises_in_lakes, coalesce(max(CASE WHEN rise > 5 THEN rise END), 0) AS worst FROM s WHERE rise IS NOT NULL", "lines"))
def descent_report(spark, sf_dir):
    return river_ops.descent_report(lines(spark, sf_dir), 5)


_ENDS = ", e AS (SELECT seg_id, arg_min(z, ord) AS first, arg_max(z, ord) AS last, max(lake_id) > 0 AS wet FROM lines GROUP BY seg_id)"


@query(sql(_ENDS + " SELECT count(*) AS segments, count(*) FILTER (last - first > 50 AND NOT wet) AS uphill, count(*) FILTER (last - first > 50 AND wet) AS uphill_with_lake FROM e", "lines"))
def flow_direction_report(spark, sf_dir):
    return river_ops.flow_direction_report(lines(spark, sf_dir), 50)


@query(sql(_ENDS.replace("max(lake_id) > 0", "false") + " SELECT l.seg_id, (CASE WHEN last - first > 2500 THEN max(ord) OVER (PARTITION BY l.seg_id) - ord ELSE ord END)::INTEGER AS ord, z FROM lines l JOIN e ON e.seg_id = l.seg_id", "lines"))
def orient_uphill(spark, sf_dir):
    rows = lines(spark, sf_dir).select("seg_id", "ord", "z", F.lit(0).alias("lake_id"))
    return river_ops.orient(rows, 2500).select("seg_id", "ord", "z")


_SHAPE = """, c AS (SELECT seg_id, ord, least(z, 6000 - ord * 40) AS cap, count(*) OVER (PARTITION BY seg_id) AS n FROM lines),
    r AS (SELECT *, min(cap) OVER (PARTITION BY seg_id ORDER BY ord) AS run, least(3, ord, n - 1 - ord) AS w FROM c),
    m AS (SELECT a.seg_id, a.ord, a.cap, sum(b.run)::DOUBLE / count(*) AS mean FROM r a JOIN r b ON a.seg_id = b.seg_id AND abs(a.ord - b.ord) <= a.w GROUP BY ALL),
    shaped AS (SELECT seg_id, ord, cap, min(least(mean, cap)) OVER (PARTITION BY seg_id ORDER BY ord) AS shaped FROM m)"""


def _shaped(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("level", F.col("z")).withColumn("ceiling", F.lit(6000) - F.col("ord") * 40)
    return profiles.shape_profile(rows, 3)


@query(sql(_SHAPE + " SELECT seg_id, ord, cap::BIGINT AS cap, round(shaped * 1000)::BIGINT AS shaped FROM shaped", "lines"))
def profile_shape(spark, sf_dir):
    return _shaped(spark, sf_dir).select("seg_id", "ord", F.col("cap").cast("long").alias("cap"), F.round(F.col("shaped") * 1000).cast("long").alias("shaped"))


@query(
    sql(
        _SHAPE
        + """, b AS (SELECT s.seg_id, s.ord, cap, lake_id = 0 AND cap - shaped > 300 AS deep, lake_id = 0 AND cap - shaped > 100 AS flank FROM shaped s JOIN lines l ON l.seg_id = s.seg_id AND l.ord = s.ord),
        g AS (SELECT *, coalesce(max(CASE WHEN NOT flank THEN ord END) OVER w + 1, 0) AS beg, CASE WHEN deep AND NOT coalesce(lag(deep) OVER w, false) THEN 1 ELSE 0 END AS fresh FROM b WINDOW w AS (PARTITION BY seg_id ORDER BY ord)),
        h AS (SELECT *, sum(fresh) OVER (PARTITION BY seg_id ORDER BY ord) AS run FROM g),
        br AS (SELECT seg_id, run, arg_min(beg, ord) AS beg, arg_max(ord, cap * 100000 - ord) AS crest FROM h WHERE deep GROUP BY seg_id, run HAVING count(*) * 3.0 > 5),
        f AS (SELECT seg_id, greatest(beg, coalesce(lag(crest) OVER (PARTITION BY seg_id ORDER BY run) + 1, 0)) AS first, crest FROM br)
    SELECT seg_id, first::INTEGER AS first, crest::INTEGER AS crest FROM f WHERE first < crest""",
        "lines",
    )
)
def barrier_runs(spark, sf_dir):
    wet = lines(spark, sf_dir).select("seg_id", "ord", (F.col("lake_id") > 0).alias("wet"), F.lit(3.0).alias("step"))
    got = profiles.barriers(_shaped(spark, sf_dir).join(wet, ["seg_id", "ord"]), cut_m=300, length_m=5, flank_m=100)
    return got.select("seg_id", F.col("first").cast("int").alias("first"), F.col("crest").cast("int").alias("crest"))


@query(sql(", p AS (SELECT row AS seg_id, col AS ord, lake_id > 0 AS wet, h FROM cells), s AS (SELECT h - lag(h) OVER w AS rise, NOT wet AND NOT lag(wet) OVER w AS open FROM p WINDOW w AS (PARTITION BY seg_id ORDER BY ord)) SELECT count(*) AS steps, count(*) FILTER (rise > 100000) AS rises FROM s WHERE rise IS NOT NULL AND open", "cells"))
def pixel_descent(spark, sf_dir):
    cells, _, _ = lattice(spark, sf_dir)
    return profiles.pixel_descent(cells.select(F.col("row").alias("seg_id"), F.col("col").alias("ord"), "cell", F.col("h").alias("bed"), (F.col("lake_id") > 0).alias("wet")), 100000)


_D8 = ", st8 AS (SELECT unnest([-1,-1,0,1,1,1,0,-1]) AS r, unnest([0,1,1,1,0,-1,-1,-1]) AS c, unnest([1,2,3,4,5,6,7,8]) AS d), lw AS (SELECT a.row, a.col, arg_max(d, ((a.code - b.code) * (a.code - b.code) * CASE WHEN d % 2 = 1 THEN 2 ELSE 1 END) * 10 - d) AS way FROM cells a, st8 JOIN cells b ON b.row = a.row + r AND b.col = a.col + c WHERE b.code < a.code GROUP BY a.row, a.col)"


@query(sql(_D8 + " SELECT cells.row, cells.col, (CASE WHEN cells.row IN (0, sy - 1) OR cells.col IN (0, sx - 1) THEN 0 ELSE coalesce(way, -1) END)::INTEGER AS flow FROM cells LEFT JOIN lw ON lw.row = cells.row AND lw.col = cells.col CROSS JOIN dim", "dim", "cells"))
def d8_strict(spark, sf_dir):
    got = flow.strict_directions(*lattice(spark, sf_dir))
    return got.select("row", "col", F.coalesce("flow", F.lit(-1)).alias("flow"))


@query()
def d8_flat_resolved(spark, sf_dir):
    return flow.directions(*lattice(spark, sf_dir))


@query()
def node_catchments(spark, sf_dir):
    cells, sy, sx = lattice(spark, sf_dir)
    return flow.catchments(flow.directions(cells, sy, sx), sx)


@query(
    sql(
        _ADJ
        + """, pr AS (SELECT a.cell AS a, b.cell AS b FROM cells a, s8 JOIN cells b ON b.row = a.row + r AND b.col = a.col + c AND b.code = a.code),
        cl(a, b) AS (SELECT cell, cell FROM cells UNION SELECT cl.a, pr.b FROM cl JOIN pr ON pr.a = cl.b), cp AS (SELECT a AS cell, min(b) AS comp FROM cl GROUP BY a),
        bad AS (SELECT DISTINCT comp FROM cp JOIN cells x USING (cell) CROSS JOIN dim WHERE x.row IN (0, sy - 1) OR x.col IN (0, sx - 1) OR EXISTS (SELECT 1 FROM cells y, s8 WHERE y.row = x.row + s8.r AND y.col = x.col + s8.c AND y.code < x.code))
    SELECT row_number() OVER (ORDER BY comp)::INTEGER AS pit, any_value(code) AS code, count(*) AS cells, comp AS first_cell FROM cp JOIN cells USING (cell) WHERE comp NOT IN (SELECT comp FROM bad) GROUP BY comp""",
        "dim",
        "cells",
    )
)
def pit_sets(spark, sf_dir):
    return flow.pits(*lattice(spark, sf_dir))


@query()
def hierarchy_nodes(spark, sf_dir):
    cells, _, _ = lattice(spark, sf_dir)
    return hierarchy.nodes(cells.withColumn("grid", F.lit(0)))


@query(
    sql(
        """, lf AS (SELECT n_nationkey AS label, n_nationkey % 6 AS floor, n_nationkey % 6 + n_regionkey * 2 AS spill FROM nation WHERE n_nationkey BETWEEN 1 AND 7), tp AS (SELECT lake_id AS label, max(code) AS top FROM cells WHERE lake_id > 0 GROUP BY lake_id),
        q AS (SELECT label, floor, greatest(spill, floor) AS s, greatest(top, spill, floor) AS t FROM lf JOIN tp USING (label)),
        ax AS (SELECT label, i AS j, (floor * (47 - i) + s * i + 23) // 47 AS code FROM q, (SELECT unnest(range(0, 48))::INTEGER AS i) UNION ALL SELECT label, 47 + k, (s * (16 - k) + t * k + 8) // 16 FROM q, (SELECT unnest(range(1, 17))::INTEGER AS k)),
        cn AS (SELECT lake_id AS label, code, count(*) AS n FROM cells GROUP BY ALL)
    SELECT ax.label, ax.j, ax.code::INTEGER AS code, coalesce(sum(n), 0)::DOUBLE * 25 AS area FROM ax LEFT JOIN cn ON cn.label = ax.label AND cn.code <= ax.code GROUP BY ax.label, ax.j, ax.code""",
        "cells",
    )
)
def hypsometry_leaf(spark, sf_dir):
    cells, _, _ = lattice(spark, sf_dir)
    leaves = table(spark, sf_dir, "nation").where("n_nationkey between 1 and 7").select(F.col("n_nationkey").alias("label"), (F.col("n_nationkey") % 6).alias("floor_code"), (F.col("n_nationkey") % 6 + F.col("n_regionkey") * 2).alias("spill_code"))
    return hierarchy.leaf_curves(leaves, cells.where("lake_id > 0").select(F.col("lake_id").alias("label"), "code"), 25.0)


@query(
    sql(
        f""", r AS (SELECT min(h) AS lo, max(h) AS hi FROM cells), pk AS (SELECT cell, lo + round_even({_SHARE} * 65534, 0) / 65534.0::DOUBLE * (hi - lo) AS level FROM cells, r WHERE kind = 1),
        nd AS (SELECT c_custkey AS node, (c_custkey * 20000)::DOUBLE AS spill, unnest([c_custkey * 3 % 1500, c_custkey * 7 % 1500]) AS cell FROM customer)
    SELECT node, round(greatest(coalesce(max(level - spill), 0), 0))::BIGINT AS head FROM nd LEFT JOIN pk USING (cell) GROUP BY node""",
        "cells",
    )
)
def outflow_heads(spark, sf_dir):
    cells, _, _ = lattice(spark, sf_dir)
    key = F.col("c_custkey")
    tree = table(spark, sf_dir, "customer").select(key.alias("node"), (key * 20000).cast("double").alias("spill_m"), (key * 3 % 1500).alias("spill_cell"), (key * 7 % 1500).alias("outlet_cell"))
    got = hierarchy.outflow_heads(tree, cells.select("cell", "kind", F.col("h").alias("surface")), *_range(cells))
    return got.select("node", F.round("head").cast("long").alias("head"))


@query(
    sql(
        """, low AS (SELECT row, col FROM cells WHERE kind = 0 AND h <= 40000000), sea(row, col) AS (SELECT row, col FROM low, dim WHERE row IN (0, sy - 1) OR col IN (0, sx - 1)
        UNION SELECT l.row, l.col FROM sea JOIN low l ON abs(l.row - sea.row) + abs(l.col - sea.col) = 1) SELECT row, col FROM sea""",
        "dim",
        "cells",
    )
)
def ocean_mask(spark, sf_dir):
    cells, sy, sx = lattice(spark, sf_dir)
    return spatial.ocean_mask(cells.withColumn("water", F.col("kind") != 0), sy, sx, 40000000)


_EDT = ", g AS (SELECT a.row, a.col, min((a.row - b.row) * (a.row - b.row)) AS g FROM cells a JOIN cells b ON a.col = b.col AND b.code = 0 GROUP BY a.row, a.col)"


@query(sql(_EDT + " SELECT a.row, a.col, min((a.col - g.col) * (a.col - g.col) + g.g)::BIGINT AS d2 FROM cells a JOIN g ON g.row = a.row GROUP BY a.row, a.col", "cells"))
def shore_distance(spark, sf_dir):
    cells, _, sx = lattice(spark, sf_dir)
    return spatial.distance(cells.withColumn("source", F.col("code") == 0), sx)


@query(
    sql(
        """, ed AS (SELECT seg_id AS id, unnest([x0, x1 + 1, (x0 + x1) // 2]) AS ax, unnest([y0 + 0.5, y1 + 0.25, (y0 + y1) // 2 + 9.75])::DOUBLE AS ay, unnest([x1 + 1, (x0 + x1) // 2, x0]) AS bx, unnest([y1 + 0.25, (y0 + y1) // 2 + 9.75, y0 + 0.5])::DOUBLE AS bb FROM rivers),
        ht AS (SELECT id, row, ax + (row - ay) * (bx - ax) / (bb - ay) AS x FROM ed JOIN (SELECT unnest(range(0, 60))::INTEGER AS row) ON row >= least(ay, bb) AND row < greatest(ay, bb))
    SELECT id, row, col FROM ht JOIN (SELECT unnest(range(0, 65))::INTEGER AS col) ON x <= col GROUP BY id, row, col HAVING count(*) % 2 = 1""",
        "rivers",
    )
)
def polygon_raster(spark, sf_dir):
    r = rivers(spark, sf_dir)
    mid = F.floor((F.col("x0") + F.col("x1")) / 2).cast("int"), F.floor((F.col("y0") + F.col("y1")) / 2) + 9.75
    corners = [(F.col("x0"), F.col("y0") + 0.5), (F.col("x1") + 1, F.col("y1") + 0.25), mid]
    sides = [F.struct(a[0].cast("double").alias("x0"), a[1].cast("double").alias("y0"), b[0].cast("double").alias("x1"), b[1].cast("double").alias("y1")) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    edges = r.select(F.col("seg_id").alias("id"), F.explode(F.array(*sides)).alias("e")).select("id", "e.*")
    return spatial.raster_polygons(edges, 60, 65)


@query(
    sql(
        """, pc AS (SELECT *, greatest(("order" + 1) / 2.0::DOUBLE, 0.51) AS half, sqrt(((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))::DOUBLE) AS len FROM rivers WHERE x0 <> x1 OR y0 <> y1),
        cv AS (SELECT row, col, seg_id, "order" FROM pc, (SELECT unnest(range(0, 45))::INTEGER AS row), (SELECT unnest(range(0, 65))::INTEGER AS col)
        WHERE ((col - x0) * (x1 - x0) + (row - y0) * (y1 - y0)) / len >= 0 AND ((col - x0) * (x1 - x0) + (row - y0) * (y1 - y0)) / len <= len AND abs((col - x0) * (y1 - y0) - (row - y0) * (x1 - x0)) / len <= half)
    SELECT row, col, (max("order" * 10000000000 + seg_id) % 10000000000)::BIGINT AS id FROM cv GROUP BY row, col""",
        "rivers",
    )
)
def line_raster(spark, sf_dir):
    pieces = rivers(spark, sf_dir).select(F.col("seg_id").alias("id"), F.col("seg_id").alias("ord"), "order", (F.col("order") + 1.0).alias("width"), "x0", "y0", "x1", "y1")
    return spatial.raster_lines(pieces, 45, 65)


@query(
    "SELECT c_custkey AS node, (c_nationkey * 2)::BIGINT AS depth, (floor(c_acctbal)::BIGINT * 25)::BIGINT AS area, (c_nationkey * 2 * floor(c_acctbal)::BIGINT * 25)::BIGINT AS score FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey * 2 >= 2 AND floor(c_acctbal)::BIGINT * 25 >= 5000 ORDER BY score DESC, node LIMIT 500"
)
def unexplained_top500(spark, sf_dir):
    tree = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.lit(0).cast("long").alias("floor_m"), (F.col("c_nationkey") * 2).cast("long").alias("spill_m"), F.floor("c_acctbal").cast("long").alias("subtree_cells"), (F.col("c_mktsegment") == "BUILDING").alias("has_lake"))
    # Customers have no tree: no node is in another, and none spills into a lake.
    none = F.lit(None)
    return hierarchy.unexplained(tree.withColumns({"parent": none.cast("long"), "overflow_to": none.cast("long"), "level": none.cast("double")}), F.lit(25))[0]


@query(
    sql(
        _NEAR_STEPS
        + """, w AS (SELECT row, col, cell FROM cells WHERE kind = 2), pr AS (SELECT a.cell AS a, b.cell AS b FROM w a JOIN w b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 AND b.cell IN (a.cell - 65, a.cell - 1, a.cell + 1, a.cell + 65)),
        cl(a, b) AS (SELECT cell, cell FROM w UNION SELECT cl.a, pr.b FROM cl JOIN pr ON pr.a = cl.b), cp AS (SELECT a AS cell, min(b) AS comp FROM cl GROUP BY a),
        body AS (SELECT row, col, comp FROM w JOIN cp USING (cell)),
        ring AS (SELECT d.row, d.col, d.h, arg_min(l.comp, (r * r + c * c) * 100000000000::BIGINT + l.row::BIGINT * 1000 + l.col) AS comp FROM cells d, st JOIN body l ON l.row = d.row + r AND l.col = d.col + c WHERE d.kind <> 2 GROUP BY d.row, d.col, d.h),
        top AS (SELECT comp, quantile_cont(h::DOUBLE, 0.75) AS top FROM ring GROUP BY comp), sh AS (SELECT comp, quantile_cont(h::DOUBLE, 0.2) AS shore FROM ring JOIN top USING (comp) WHERE h >= top - 20000000 GROUP BY comp)
    SELECT cells.row, cells.col, round(CASE WHEN shore IS NOT NULL AND h < shore - 20000000 THEN shore ELSE h END, 3) AS h FROM cells LEFT JOIN (body JOIN sh USING (comp)) x ON x.row = cells.row AND x.col = cells.col""",
        "cells",
    )
)
def void_repair(spark, sf_dir):
    cells, _, sx = lattice(spark, sf_dir)
    return lakes.fill_voids(cells, sx, void_below=20000000).select("row", "col", F.round(F.col("h").cast("double"), 3).alias("h"))


@query(
    """SELECT c_custkey AS seg_id, [2.0, 3.0, 5.0, 8.0, 14.0, 25.0, 45.0, 80.0][least(greatest(c_custkey % 10, 1), 8)]::DOUBLE AS width, [1.5, 2.25, 3.0, 4.0, 5.5, 7.0, 9.0, 11.0][least(greatest(c_custkey % 10, 1), 8)]::DOUBLE AS depth,
    CASE WHEN c_custkey % 10 > 0 THEN greatest([2.0, 3.0, 5.0, 8.0, 14.0, 25.0, 45.0, 80.0][least(c_custkey % 10, 8)] / 2, 2.5)::DOUBLE ELSE 2.5 END AS half_width FROM customer"""
)
def order_tables(spark, sf_dir):
    order = (F.col("c_custkey") % 10).cast("int")
    width, depth = hydraulics.by_order(order, hydraulics.WIDTH_BY_ORDER), hydraulics.by_order(order, hydraulics.DEPTH_BY_ORDER)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seg_id"), width.alias("width"), depth.alias("depth"), hydraulics.channel_half_width(order, 5.0).alias("half_width"))


@query(
    sql(
        _RING
        + _INTERIOR
        + _PARENTS
        + """, pk AS (SELECT code, lake_id, h FROM cells), top AS (SELECT prow, pcol, min(h) AS low FROM cells JOIN gc USING (col) JOIN gr USING (row) WHERE kind > 0 GROUP BY prow, pcol)
    SELECT lake_id, count(*) AS samples, min(h) AS low, max(h) AS high, coalesce(max(estimate), -1) AS estimate, coalesce(round(max(p25), 3), -1) AS shore FROM pk LEFT JOIN interior USING (lake_id) LEFT JOIN rings USING (lake_id) WHERE lake_id > 0 GROUP BY lake_id""",
        "dim",
        "cells",
    )
)
def lake_statistics(spark, sf_dir):
    """The flagship: each lake's extent in height, its estimate from inside and its shore from outside."""
    cells, _, _ = lattice(spark, sf_dir)
    own = cells.where("lake_id > 0").groupBy("lake_id").agg(F.count(F.lit(1)).alias("samples"), F.min("h").alias("low"), F.max("h").alias("high"))
    got = own.join(lakes.interior_levels(cells), "lake_id", "left").join(lakes.ring_percentiles(cells, {"p25": 0.25}).select("lake_id", "p25"), "lake_id", "left")
    return got.select("lake_id", "samples", "low", "high", F.coalesce(F.round("estimate", 3), F.lit(-1.0)).alias("estimate"), F.coalesce(F.round("p25", 3), F.lit(-1.0)).alias("shore"))


_CHORD = ", ch AS (SELECT seg_id, ord, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM lines WINDOW w AS (PARTITION BY seg_id ORDER BY ord))"


@query(sql(_CHORD + " SELECT seg_id, ord, round(-dy / sqrt(dx * dx + dy * dy), 6) AS nx, round(dx / sqrt(dx * dx + dy * dy), 6) AS ny FROM ch WHERE dx <> 0 OR dy <> 0", "lines"))
def vertex_normals(spark, sf_dir):
    return measures.normals(lines(spark, sf_dir)).where("nx is not null").select("seg_id", "ord", F.round("nx", 6).alias("nx"), F.round("ny", 6).alias("ny"))


@query(
    sql(
        """, st AS (SELECT seg_id, ord, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS bb FROM lines WINDOW w AS (PARTITION BY seg_id ORDER BY ord))
    SELECT seg_id, ord, round(coalesce(2.0::DOUBLE * atan2(ax * bb - ay * bx, ax * bx + ay * bb) / (sqrt(ax * ax + ay * ay) + sqrt(bx * bx + bb * bb)), 0), 6) AS curvature FROM st""",
        "lines",
    )
)
def line_curvature(spark, sf_dir):
    return measures.curvature(lines(spark, sf_dir)).select("seg_id", "ord", F.round("curvature", 6).alias("curvature"))


@query()
def geometry_hash(spark, sf_dir):
    return measures.geometry_hash(lines(spark, sf_dir))


@query(
    """WITH i AS (SELECT event_id AS id, user_id AS reach, floor(value)::BIGINT AS lo, floor(value)::BIGINT + event_id % 4 + 1 AS hi FROM events),
    f AS (SELECT *, max(hi) OVER (PARTITION BY reach ORDER BY lo, hi, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM i)
    SELECT id, reach, (sum(CASE WHEN far IS NULL OR lo >= far THEN 1 ELSE 0 END) OVER (PARTITION BY reach ORDER BY lo, hi, id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS "group" FROM f"""
)
def overlap_groups(spark, sf_dir):
    low = F.floor("value")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("reach"), low.alias("lo"), (low + F.col("event_id") % 4 + 1).alias("hi"))
    return measures.overlap_groups(rows).select("id", "reach", F.col("group").cast("long").alias("group"))


@query(
    """WITH c AS (SELECT c_nationkey AS label, floor(c_acctbal)::BIGINT AS aa, arg_min((c_custkey % 100)::DOUBLE, c_custkey) AS first, arg_max((c_custkey % 100)::DOUBLE, c_custkey) AS last FROM customer GROUP BY 1, 2),
    p AS (SELECT s_suppkey AS id, s_nationkey AS label, floor(s_acctbal)::BIGINT AS z FROM supplier),
    a AS (SELECT id, arg_max(last, aa) AS v, max(aa) AS aa FROM p JOIN c ON c.label = p.label AND aa <= z GROUP BY id), b AS (SELECT id, arg_min(first, aa) AS v, min(aa) AS aa FROM p JOIN c ON c.label = p.label AND aa > z GROUP BY id)
    SELECT p.id, CASE WHEN a.aa = z THEN a.v ELSE coalesce(a.v + (b.v - a.v) * ((z - a.aa) / (b.aa - a.aa)), a.v, b.v) END AS value FROM p LEFT JOIN a USING (id) LEFT JOIN b USING (id) WHERE coalesce(a.v, b.v) IS NOT NULL"""
)
def curve_lookup(spark, sf_dir):
    curves = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("label"), F.col("c_custkey").alias("j"), F.floor("c_acctbal").alias("at"), (F.col("c_custkey") % 100).alias("value"))
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("label"), F.floor("s_acctbal").alias("z"))
    return measures.curve_values(points, curves).where("value is not null").select("id", "value")


@query(
    """SELECT c_custkey AS seg_id, CASE WHEN c_custkey % 7 = 0 THEN 12.5 WHEN c_custkey % 4 = 2 THEN least(c_custkey % 30, 3) WHEN c_custkey % 4 = 3 THEN least(greatest(c_custkey % 30, 3), 15) ELSE c_custkey % 30 END::DOUBLE AS width FROM customer"""
)
def class_widths(spark, sf_dir):
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(key.alias("seg_id"), F.lit(0).alias("ord"), (key % 30).cast("double").alias("width"), (key % 4).alias("width_class"), F.when(key % 7 == 0, 12.5).alias("measured"))
    return measures.class_widths(rows).select("seg_id", "width")


@query("""SELECT c_custkey AS branch, round((1 + c_custkey % 7) * (1 + c_custkey % 7)::DOUBLE / ((10 + c_nationkey) * (10 + c_nationkey) + sum((1 + c_custkey % 7) * (1 + c_custkey % 7)) OVER (PARTITION BY c_nationkey)), 9) AS share FROM customer""")
def side_channel_shares(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("branch"), F.col("c_nationkey").alias("reach"), (1 + F.col("c_custkey") % 7).cast("double").alias("width"), (10 + F.col("c_nationkey")).cast("double").alias("stem_width"))
    return beds.side_channel_shares(rows).select("branch", F.round("share", 9).alias("share"))


@query(
    sql(
        """ SELECT a.seg_id, CASE WHEN b.seg_id IS NULL THEN 'no such segment' WHEN a.downstream = a.seg_id THEN 'its own downstream' ELSE 'less discharge downstream' END AS error FROM rivers a LEFT JOIN rivers b ON b.seg_id = a.downstream
    WHERE a.downstream IS NOT NULL AND (b.seg_id IS NULL OR a.downstream = a.seg_id OR b.area_km2 < a.area_km2) UNION ALL SELECT seg_id, 'unknown lake' FROM rivers WHERE unit NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)""",
        "rivers",
    )
)
def referential_checks(spark, sf_dir):
    seg = rivers(spark, sf_dir).withColumn("discharge", F.col("area_km2"))
    known = table(spark, sf_dir, "nation").where("n_regionkey < 4").select(F.col("n_nationkey").alias("lake_id"))
    return audit.check_links(seg, seg.select("seg_id", F.col("unit").alias("lake_id")), known)


@query(
    """WITH s AS (SELECT l_suppkey AS lake, l_quantity / 50 AS q, l_discount * 100 + 1 AS depth FROM lineitem WHERE l_quantity > 0),
    g AS (SELECT * FROM (SELECT unnest([0.7, 0.9, 1.1])::DOUBLE AS k), (SELECT unnest([0.4, 0.6, 0.8])::DOUBLE AS b), (SELECT unnest([0.8, 1.0, 1.2])::DOUBLE AS scale)),
    e AS (SELECT k, b, scale, lake, depth, (1 - exp(-q * k / b)) * b * 12 * scale AS model FROM s, g),
    l AS (SELECT k, b, scale, lake, abs(ln(max(model) / max(depth))) AS m1, abs(ln(avg(model) / avg(depth))) AS m2, median(abs(ln(model / depth))) AS m3 FROM e GROUP BY ALL)
    SELECT k, b, scale, round(median(m1), 6) AS max_error, round(median(m2), 6) AS mean_error, round(median(m3), 6) AS point_error FROM l GROUP BY k, b, scale"""
)
def calibration_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("lake_id"), (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 100 + 1).alias("depth"), F.lit(12.0).alias("reach"))
    got = measures.calibration(rows)
    return got.select("k", "b", "scale", *(F.round(c, 6).alias(c) for c in ("max_error", "mean_error", "point_error")))


@query()
def shore_parts(spark, sf_dir):
    cells, sy, sx = lattice(spark, sf_dir)
    return shores.split_shores(cells, _levels(cells), sy, sx, 5.0, shores.ShoreRules(plane_m=2e6, flat_m=1e6, edge_drop_m=1e5, island_m=1e6))


@query()
def lake_bed_ramp(spark, sf_dir):
    cells, _, sx = lattice(spark, sf_dir)
    return beds.lake_ramp(cells, sx, 5.0)


@query(
    sql(
        """, ds AS (SELECT r, c FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS r), (SELECT unnest([-2, -1, 0, 1, 2]) AS c) WHERE r * r + c * c <= 4), sr AS (SELECT row, col, h FROM cells WHERE kind = 1),
        nr AS (SELECT v.row, v.col, min((r * r + c * c) * 100000000::BIGINT + s.row * 1000 + s.col) AS k FROM cells v, ds JOIN sr s ON s.row = v.row + r AND s.col = v.col + c WHERE v.kind = 1 GROUP BY v.row, v.col),
        t AS (SELECT v.row, v.col, v.h::DOUBLE AS h, s.h::DOUBLE AS level, greatest(1 - sqrt(k // 100000000) * 5 / 10.0::DOUBLE, 0) AS u, greatest(least(1 - greatest(v.h - s.h, 0) / 1e6, 1), 0) AS w FROM nr JOIN cells v ON v.row = nr.row AND v.col = nr.col JOIN sr s ON s.row = (k % 100000000) // 1000 AND s.col = k % 1000)
    SELECT cells.row, cells.col, round(coalesce(least(t.h, least(t.h, level) - 50000 * (u * u * (3 - 2 * u)) * (w * w * (3 - 2 * w)) + greatest(t.h - level, 0)), cells.h), 3) AS h FROM cells LEFT JOIN t ON t.row = cells.row AND t.col = cells.col""",
        "cells",
    )
)
def river_trench(spark, sf_dir):
    cells, _, _ = lattice(spark, sf_dir)
    centre = cells.where("kind = 1").select("row", "col", F.col("h").cast("double").alias("level"), F.lit(50000.0).alias("depth"), F.lit(10.0).alias("half_width"))
    return beds.carve_rivers(cells, centre, 2, 5.0, tolerance_m=1e6).select("row", "col", F.round("h", 3).alias("h"))


@query(
    sql(
        _SPANS
        + """, n AS (SELECT row AS seg_id, max(col) + 1 AS n FROM cells GROUP BY row), lv AS (SELECT s.seg_id, s.a, s.b, s.lake_id, median(h::DOUBLE) AS level FROM spans s JOIN cells ON row = s.seg_id AND col BETWEEN s.a AND s.b AND cells.lake_id > 0 GROUP BY ALL),
        e AS (SELECT lv.*, 'inflow' AS kind, a AS ord, 1 AS step FROM lv WHERE a > 0 UNION ALL SELECT lv.*, 'outflow', b, -1 FROM lv JOIN n USING (seg_id) WHERE b < n - 1),
        o AS (SELECT e.*, k, level - h AS d FROM e, (SELECT unnest([1, 2, 3]) AS k) JOIN cells ON row = e.seg_id AND col = e.ord - e.step * k),
        s AS (SELECT seg_id, lake_id, kind, ord, level, median(d) AS mid, greatest(min(d), 0) AS low, max(CASE WHEN k = 1 THEN 6.0 END) AS width FROM o GROUP BY ALL)
    SELECT seg_id, lake_id, kind, ord, round(level, 1) AS level, round(CASE WHEN kind = 'inflow' THEN least(mid, 5e6) ELSE least(low, 1e7) END, 1) AS depth, (width / 2)::DOUBLE AS half_width, kind = 'outflow' AND low > 1e7 AS capped FROM s""",
        "cells",
    )
)
def river_mouths(spark, sf_dir):
    spans, _ = _spans(spark, sf_dir)
    cells, _, _ = lattice(spark, sf_dir)
    vertices = cells.select(F.col("row").alias("seg_id"), F.col("col").alias("ord"), F.col("h").alias("bed"), F.when(F.col("lake_id") > 0, F.col("h")).alias("surface"), F.lit(6.0).alias("width"), F.lit(5e6).alias("order_depth"))
    return beds.mouths(vertices, spans).select("seg_id", "lake_id", "kind", "ord", F.round("level", 1).alias("level"), F.round("depth", 1).alias("depth"), "half_width", "capped")


def _octave_sql(name: str, source: str) -> str:
    """Common table expressions that end in ``name(id, k, v)``: value noise at ``source(id, k, x, y, size, salt)``, a lattice corner's hash in 64-bit arithmetic by way of 128-bit products."""
    two64 = "18446744073709551616::UHUGEINT"
    m = [f"{k}::UHUGEINT" for k in beds.MULTIPLIERS]
    times = lambda a, k: f"((({a})::UHUGEINT * {m[k]}) % {two64})::UBIGINT"
    wrapped = lambda v: f"((({v})::HUGEINT + 18446744073709551616) % 18446744073709551616)::UHUGEINT"
    return f""", {name}_c AS (SELECT id, k, x / size - floor(x / size) AS fx, y / size - floor(y / size) AS fy, a, b, floor(x / size)::BIGINT + a AS i, floor(y / size)::BIGINT + b AS j, salt FROM {source}, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
    {name}_0 AS (SELECT *, xor(xor({times(wrapped("i"), 0)}, {times(wrapped("j"), 1)}), {times("salt", 4)}) AS h FROM {name}_c),
    {name}_1 AS (SELECT *, {times("xor(h, h >> 30)", 2)} AS h1 FROM {name}_0), {name}_2 AS (SELECT *, {times("xor(h1, h1 >> 27)", 3)} AS h2 FROM {name}_1),
    {name}_3 AS (SELECT *, (xor(h2, h2 >> 31) >> 11)::DOUBLE / 4503599627370496 - 1 AS g, fx * fx * fx * (fx * (fx * 6 - 15) + 10) AS s, fy * fy * fy * (fy * (fy * 6 - 15) + 10) AS t FROM {name}_2),
    {name} AS (SELECT id, k, sum(g * CASE a WHEN 1 THEN s ELSE 1 - s END * CASE b WHEN 1 THEN t ELSE 1 - t END) AS v FROM {name}_3 GROUP BY id, k)"""


@query(
    sql(
        ", bi AS (SELECT cell AS id, k, col * 5.0::DOUBLE AS x, row * 5.0::DOUBLE AS y, 400.0::DOUBLE AS size, k AS salt FROM cells, (SELECT unnest([7, 11]) AS k))"
        + _octave_sql("bend", "bi")
        + """, oi AS (SELECT cell AS id, q.k, col * 5.0::DOUBLE + 140 * u.v AS x, row * 5.0::DOUBLE + 140 * w.v AS y, 400.0::DOUBLE / 2 ** q.k AS size, 17 + q.k AS salt FROM cells JOIN bend u ON u.id = cell AND u.k = 7 JOIN bend w ON w.id = cell AND w.k = 11, (SELECT unnest([0, 1, 2, 3, 4]) AS k) q)"""
        + _octave_sql("oct", "oi")
        + " SELECT row, col, greatest(-1, least(1, 1.6::DOUBLE * sum(v / 2 ** k) / 1.9375))::FLOAT::DOUBLE AS noise FROM oct JOIN cells ON cell = id GROUP BY row, col",
        "cells",
    )
)
def world_noise(spark, sf_dir):
    cells, _, _ = lattice(spark, sf_dir)
    return cells.select("row", "col", beds.noise(F.col("col") * 5.0, F.col("row") * 5.0, wavelength_m=400, octaves=5).alias("noise"))


@query(
    sql(
        _SHAPE
        + """, n AS (SELECT seg_id, ord, shaped AS z, 100 + 0.3::DOUBLE * ((count(*) OVER (PARTITION BY seg_id) - 1 - ord) * 3.0) AS bound FROM shaped),
        st AS (SELECT *, max(CASE WHEN z - bound > 300 + 1e-9 THEN ord END) OVER (PARTITION BY seg_id) AS stop FROM n),
        al AS (SELECT *, CASE WHEN stop IS NULL THEN NULL WHEN stop = 0 THEN 300 ELSE least(greatest((ord - greatest(stop - 4, 0))::DOUBLE / (stop - greatest(stop - 4, 0)), 0), 1) * 300 END AS allowed FROM st)
    SELECT seg_id, ord, round(least(z, CASE WHEN allowed IS NULL THEN bound ELSE greatest(bound, z - allowed) END) * 1000)::BIGINT AS surface FROM al""",
        "lines",
    )
)
def graded_tails(spark, sf_dir):
    rows = _shaped(spark, sf_dir).select(F.col("seg_id").cast("long").alias("seg_id"), "ord", F.col("shaped").alias("surface"), F.lit(3.0).alias("along"), F.lit(100.0).alias("junction"), F.lit(300.0).alias("most"))
    return paths.grade_tails(rows).select("seg_id", "ord", F.round(F.col("surface") * 1000).cast("long").alias("surface"))


@query()
def snapped_offsets(spark, sf_dir):
    rows = lines(spark, sf_dir).select(F.col("seg_id").cast("long").alias("seg_id"), "ord", F.lit(3.0).alias("along"), F.transform(F.sequence(F.lit(-5), F.lit(5)), lambda k: F.abs(k - F.col("z") % 11 + 5).cast("double")).alias("costs"))
    return paths.snap_lines(rows)


@query()
def lake_matches(spark, sf_dir):
    cells, _, sx = lattice(spark, sf_dir)
    named = hierarchy.labels(cells.withColumn("grid", F.lit(0))).select("row", "col", "label").join(cells, ["row", "col"]).select("label", "lake_id", F.col("code").cast("double").alias("h"))
    tree = hierarchy.nodes(cells.withColumn("grid", F.lit(0))).select("node", "parent", F.col("spill_code").cast("double").alias("spill_m"), F.lit(0.0).alias("head"))
    levels = cells.where("lake_id > 0").groupBy("lake_id").agg(F.avg("code").alias("level")).withColumn("regulated", F.lit(False))
    return audit.match_lakes(named, tree, levels)


@query(sql(""" SELECT seg_id, '{"type":"Feature","geometry":{"type":"LineString","coordinates":[' || string_agg('[' || x::VARCHAR || ',' || y::VARCHAR || ']', ',' ORDER BY ord) || ']},"properties":{"seg_id":' || seg_id || '}}' AS json FROM lines GROUP BY seg_id""", "lines"))
def feature_geojson(spark, sf_dir):
    return features.to_geojson(lines(spark, sf_dir))
