"""Queries of lines, networks and trees on the test tables, and the SQL that says what each returns. Registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.bindings import lattice, lines, rivers, sql, table
from tarn.functions import codecs
from tarn.operators import branches, downhill, geometry, shores, spatial, stencil, trees, walks
from tarn.queries import _ADJ, _PARENTS, _levels, query
from tarn.sources import fetch, network, previews


@query(
    sql(
        """, b(seg_id, r, c, r1, c1, dr, dc, err, place) AS (SELECT seg_id, y0, x0, y1, x1, abs(y1 - y0), abs(x1 - x0), abs(x1 - x0) - abs(y1 - y0), 0 FROM rivers
        UNION ALL SELECT seg_id, r + CASE WHEN 2 * err < dc THEN sign(r1 - r) ELSE 0 END, c + CASE WHEN 2 * err > -dr THEN sign(c1 - c) ELSE 0 END, r1, c1, dr, dc,
        err - CASE WHEN 2 * err > -dr THEN dr ELSE 0 END + CASE WHEN 2 * err < dc THEN dc ELSE 0 END, place + 1 FROM b WHERE r <> r1 OR c <> c1)
    SELECT seg_id, place::BIGINT AS place, r::INTEGER AS row, c::INTEGER AS col FROM b WHERE r < 37 AND c < 40""",
        "rivers",
    )
)
def pixel_paths(spark, sf_dir):
    """Cells of straight lines; SQL walks them with the usual error term."""
    r = rivers(spark, sf_dir)
    ends = r.select("seg_id", F.lit(0).alias("ord"), F.col("y0").alias("row"), F.col("x0").alias("col")).union(r.select("seg_id", F.lit(1), "y1", "x1"))
    return geometry.pixel_path(ends, (37, 40)).select("seg_id", F.col("place").cast("long").alias("place"), "row", "col")


_ARCS = """, st AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ^ 2 + (y - lag(y) OVER w) ^ 2), 0) AS step FROM lines WINDOW w AS (PARTITION BY seg_id ORDER BY ord)),
    ar AS (SELECT *, sum(step) OVER (PARTITION BY seg_id ORDER BY ord) AS arc FROM st), ln AS (SELECT seg_id, max(arc) AS total FROM ar GROUP BY seg_id),
    pc AS (SELECT seg_id, ord, x, y, arc, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(arc) OVER w AS narc FROM ar WINDOW w AS (PARTITION BY seg_id ORDER BY ord))"""


@query(
    sql(
        _ARCS
        + """, k AS (SELECT seg_id, total, greatest(ceil(total / 40), 1)::BIGINT AS parts, unnest(range(0, greatest(ceil(total / 40), 1)::BIGINT + 1)) AS k FROM ln WHERE total > 0),
        t AS (SELECT seg_id, k, least(k * (total / parts), total) AS arc FROM k),
        f AS (SELECT t.seg_id, k, t.arc, x, y, nx, ny, pc.arc AS a, narc FROM t JOIN pc ON pc.seg_id = t.seg_id AND narc IS NOT NULL AND pc.arc <= t.arc + 1e-9 AND narc >= t.arc - 1e-9 QUALIFY row_number() OVER (PARTITION BY t.seg_id, k ORDER BY ord) = 1)
    SELECT seg_id, k, round(arc, 3) AS arc, round(x + (nx - x) * greatest(0, least(1, (arc - a) / (narc - a))), 3) AS x, round(y + (ny - y) * greatest(0, least(1, (arc - a) / (narc - a))), 3) AS y FROM f
    UNION ALL SELECT seg_id, 0, 0, round(x, 3), round(y, 3) FROM lines JOIN ln USING (seg_id) WHERE total = 0 AND ord = 0""",
        "lines",
    )
)
def even_points(spark, sf_dir):
    return geometry.even(lines(spark, sf_dir), 40.0).select("seg_id", "k", *(F.round(c, 3).alias(c) for c in ("arc", "x", "y")))


_PASS = """, {out} AS (SELECT p.seg_id, p.ord, p.n, CASE WHEN p.ord IN (0, p.n - 1) OR p.n <= 5 THEN max(p.x) ELSE avg(q.x) END AS x, CASE WHEN p.ord IN (0, p.n - 1) OR p.n <= 5 THEN max(p.y) ELSE avg(q.y) END AS y
    FROM {src} p, (SELECT unnest([-2, -1, 0, 1, 2]) AS d) JOIN {src} q ON q.seg_id = p.seg_id AND q.ord = greatest(0, least(p.n - 1, p.ord + d)) GROUP BY p.seg_id, p.ord, p.n)"""


@query(sql(", s0 AS (SELECT *, count(*) OVER (PARTITION BY seg_id) AS n FROM lines)" + "".join(_PASS.format(out=f"s{k + 1}", src=f"s{k}") for k in range(3)) + " SELECT seg_id, ord, round(x, 4) AS x, round(y, 4) AS y FROM s3", "lines"))
def smoothed_lines(spark, sf_dir):
    rows = lines(spark, sf_dir).select("seg_id", "ord", "x", "y")
    return geometry.smoothed(rows).select("seg_id", "ord", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(sql(" SELECT seg_id, min(ord)::INTEGER AS a, (max(ord) + 1)::INTEGER AS b FROM (SELECT seg_id, ord, ord - row_number() OVER (PARTITION BY seg_id ORDER BY ord) AS run FROM lines WHERE lake_id > 0) GROUP BY seg_id, run HAVING count(*) >= 2", "lines"))
def mask_runs(spark, sf_dir):
    got = geometry.true_runs(lines(spark, sf_dir).withColumn("wet", F.col("lake_id") > 0), "wet", 2)
    return got.select("seg_id", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))


#: Customers as a binary tree under a root 0.
_TREE = "tree AS (SELECT 0::BIGINT AS node, NULL::BIGINT AS parent, false AS authored, NULL::DOUBLE AS level, 0::DOUBLE AS spill_m, 0::DOUBLE AS head UNION ALL SELECT c_custkey, c_custkey // 2, c_mktsegment = 'BUILDING', c_nationkey * 10.0::DOUBLE, (c_custkey % 11 * 20)::DOUBLE, (c_custkey % 7)::DOUBLE * 8 FROM customer WHERE c_custkey > 0)"


def _tree(spark, sf_dir):
    key = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").where(key > 0).select(key.alias("node"), F.floor(key / 2).alias("parent"), (F.col("c_mktsegment") == "BUILDING").alias("authored"), (F.col("c_nationkey") * 10.0).alias("level"), (key % 11 * 20).cast("double").alias("spill_m"), ((key % 7) * 8).cast("double").alias("head"))
    root = spark.createDataFrame([(0, None, False, None, 0.0, 0.0)], "node long, parent long, authored boolean, level double, spill_m double, head double")
    return own.union(root)


@query(
    f"""WITH RECURSIVE {_TREE}, p AS (SELECT node, [node] AS path FROM tree WHERE parent IS NULL UNION ALL SELECT t.node, list_append(p.path, t.node) FROM tree t JOIN p ON t.parent = p.node),
    sz AS (SELECT a AS node, count(*) AS size FROM (SELECT unnest(path) AS a FROM p) GROUP BY a)
    SELECT node, row_number() OVER (ORDER BY path) - 1 AS tin, row_number() OVER (ORDER BY path) - 1 + size AS tout FROM p JOIN sz USING (node)"""
)
def subtree_intervals(spark, sf_dir):
    return trees.subtree_intervals(_tree(spark, sf_dir).select("node", "parent"))


_OWN = "own AS (SELECT code * 3 AS node, min(n_nationkey * 25)::DOUBLE AS own FROM cells JOIN nation ON n_nationkey = lake_id WHERE lake_id > 0 AND code > 0 AND n_regionkey < 4 GROUP BY code)"
_LOW = f"""{_TREE}, {_OWN}, st AS (SELECT node, parent, own AS low, least(CASE WHEN authored THEN level END, own) AS sent FROM tree LEFT JOIN own USING (node)),
    up(node, pl, v) AS (SELECT node, parent, sent FROM st WHERE sent IS NOT NULL AND parent > 0 UNION ALL SELECT up.node, t.parent, v FROM up JOIN tree t ON t.node = up.pl WHERE t.parent > 0),
    low AS (SELECT st.node, least(min(v), any_value(low)) AS low FROM st LEFT JOIN up ON up.pl = st.node GROUP BY st.node)"""


def _own(spark, sf_dir):
    cells, _, _ = lattice(spark, sf_dir)
    levels = table(spark, sf_dir, "nation").where("n_regionkey < 4").select(F.col("n_nationkey").alias("lake_id"), (F.col("n_nationkey") * 25).cast("double").alias("level"))
    return trees.lake_sample_levels(cells.select((F.col("code") * 3).alias("label"), "lake_id"), levels)


@query(sql(f", {_OWN} SELECT node::BIGINT AS node, own FROM own", "cells"))
def lake_sample_levels(spark, sf_dir):
    return _own(spark, sf_dir).select(F.col("node").cast("long").alias("node"), "own")


@query(sql(f", {_LOW} SELECT node, low FROM low WHERE low IS NOT NULL", "cells"))
def lowest_levels(spark, sf_dir):
    own = _own(spark, sf_dir).select(F.col("node").cast("long").alias("node"), "own")
    return trees.lowest_levels_below(_tree(spark, sf_dir), own).where("low is not null")


@query(
    sql(
        f""", {_LOW} SELECT node, CASE WHEN NOT authored AND low IS NOT NULL AND head > greatest(low - spill_m, 0) THEN greatest(low - spill_m, 0) ELSE head END AS head,
    coalesce(NOT authored AND head > greatest(low - spill_m, 0) AND low IS NOT NULL, false) AS capped FROM tree JOIN low USING (node)""",
        "cells",
    )
)
def capped_heads(spark, sf_dir):
    own = _own(spark, sf_dir).select(F.col("node").cast("long").alias("node"), "own")
    return trees.capped_heads(_tree(spark, sf_dir), own)


@query(
    sql(
        """, up(seg_id, place, d) AS (SELECT seg_id, seg_id, 0 FROM rivers UNION ALL SELECT up.seg_id, r.downstream, d + 1 FROM up JOIN rivers r ON r.seg_id = up.place WHERE r.downstream IN (SELECT seg_id FROM rivers))
    SELECT place AS seg_id, max(d)::BIGINT AS rank, false AS cyclic FROM up GROUP BY place""",
        "rivers",
    )
)
def link_ranks(spark, sf_dir):
    return downhill.flow_order(rivers(spark, sf_dir)).select("seg_id", "rank", "cyclic")


@query(
    sql(
        """, up(seg_id, pl, below) AS (SELECT seg_id, seg_id, 0::BIGINT FROM rivers UNION ALL SELECT up.seg_id, r.downstream, below + d.length FROM up JOIN rivers r ON r.seg_id = up.pl JOIN rivers d ON d.seg_id = r.downstream)
    SELECT seg_id, max(below)::DOUBLE AS below, arg_max(pl, below) AS sink FROM up GROUP BY seg_id""",
        "rivers",
    )
)
def downstream_positions(spark, sf_dir):
    return walks.downstream_positions(rivers(spark, sf_dir))


@query(
    sql(
        """, ch(id, seg_id, begins, ends) AS (SELECT seg_id, seg_id, 0::BIGINT, length // 2 FROM rivers UNION ALL SELECT ch.id, d.seg_id, ends, ends + d.length FROM ch JOIN rivers r ON r.seg_id = ch.seg_id JOIN rivers d ON d.seg_id = r.downstream WHERE ends < 500)
    SELECT id, seg_id, begins::DOUBLE AS begins FROM ch""",
        "rivers",
    )
)
def lines_below(spark, sf_dir):
    r = rivers(spark, sf_dir)
    return walks.lines_below(r.select(F.col("seg_id").alias("id"), "seg_id", F.floor(F.col("length") / 2).alias("left")), r, 500.0)


@query(
    sql(
        """, ch(id, seg_id, begins, ends) AS (SELECT seg_id, seg_id, 0::BIGINT, length // 2 FROM rivers UNION ALL SELECT ch.id, d.seg_id, ends, ends + d.length FROM ch JOIN rivers r ON r.seg_id = ch.seg_id JOIN rivers d ON d.seg_id = r.downstream WHERE ends < 300),
        sp AS (SELECT seg_id, unit AS lake_id, length // 4 AS enters, length // 4 + 10 AS leaves FROM rivers WHERE unit < 10)
    SELECT DISTINCT id, lake_id FROM ch JOIN sp USING (seg_id) JOIN rivers o ON o.seg_id = ch.id
    WHERE CASE WHEN ch.seg_id = id THEN leaves >= o.length - o.length // 2 AND greatest(enters - (o.length - o.length // 2), 0) <= 300 ELSE begins + enters <= 300 END""",
        "rivers",
    )
)
def lakes_below(spark, sf_dir):
    r = rivers(spark, sf_dir)
    half = F.floor(F.col("length") / 2)
    spans = r.where("unit < 10").select("seg_id", F.col("unit").alias("lake_id"), F.floor(F.col("length") / 4).alias("enters"), (F.floor(F.col("length") / 4) + 10).alias("leaves"))
    return walks.lakes_below(r.select(F.col("seg_id").alias("id"), "seg_id", half.alias("left"), (F.col("length") - half).alias("at")), r, spans, 300.0)


@query(
    sql(
        """, s AS (SELECT seg_id, x < 60 AS i, CASE WHEN x < 60 AND lag(x) OVER w < 60 THEN sqrt((x - lag(x) OVER w) ^ 2 + (y - lag(y) OVER w) ^ 2) ELSE 0 END AS step FROM lines WINDOW w AS (PARTITION BY seg_id ORDER BY ord))
    SELECT seg_id, round(avg(i::INTEGER), 6) AS inside, round(sum(step), 4) AS inside_m FROM s GROUP BY seg_id HAVING avg(i::INTEGER) > 0 AND (avg(i::INTEGER) >= 0.5 OR sum(step) >= 200)""",
        "lines",
    )
)
def area_carriers(spark, sf_dir):
    got = walks.carriers(lines(spark, sf_dir).withColumn("inside", F.col("x") < 60))
    return got.select("seg_id", F.round("inside", 6).alias("inside"), F.round("inside_m", 4).alias("inside_m"))


@query(sql(" SELECT seg_id, ord, lake_id > 0 OR ord BETWEEN 3 AND 5 AS wet, CASE WHEN ord % 3 = 0 THEN ord + 1 WHEN ord % 3 = 1 THEN seg_id % 9 + 1 ELSE 1 END / 2.0::DOUBLE AS half_width FROM lines", "lines"))
def wet_vertices(spark, sf_dir):
    rows = lines(spark, sf_dir)
    spans = rows.where("lake_id > 0").select("seg_id", F.col("ord").alias("a"), F.col("ord").alias("b")).union(rows.select("seg_id", F.lit(3), F.lit(5)).distinct())
    wide = walks.wet_vertices(rows, spans).withColumn("vertex_width", F.when(F.col("ord") % 3 == 0, (F.col("ord") + 1).cast("double"))).withColumn("width", F.when(F.col("ord") % 3 == 1, (F.col("seg_id") % 9 + 1).cast("double")))
    return walks.half_widths(wide).select("seg_id", "ord", "wet", "half_width")


_WAYS = ", wy AS (SELECT unnest([1,2,3,4,5,6,7,8]) AS d, unnest([-1,-1,0,1,1,1,0,-1]) AS r, unnest([0,1,1,1,0,-1,-1,-1]) AS c), fl AS (SELECT row, col, cell, ((h // 1000) % 9)::INTEGER AS flow FROM cells), nx AS (SELECT fl.cell, n.cell AS nxt FROM fl JOIN wy ON d = flow JOIN cells n ON n.row = fl.row + r AND n.col = fl.col + c)"


@query(
    sql(
        _WAYS
        + """, wk(cell, pl) AS (SELECT cell, cell FROM fl UNION SELECT wk.cell, nxt FROM wk JOIN nx ON nx.cell = wk.pl)
    SELECT pl AS cell, count(*) AS samples FROM wk WHERE pl NOT IN (SELECT cell FROM nx) GROUP BY pl""",
        "cells",
    )
)
def drainage_counts(spark, sf_dir):
    """Made-up flow codes from the heights, with cycles, whose samples drain nowhere."""
    cells, _, sx = lattice(spark, sf_dir)
    coded = cells.withColumn("flow", (F.floor(F.col("h") / 1000) % 9).cast("int"))
    return walks.drainage_counts(coded.select("row", "col", "flow"), sx)


@query(
    sql(
        """, ud AS (SELECT c_custkey AS node, c_nationkey % 8 AS own, unnest([c_custkey * 3 % 1500, c_custkey * 7 % 1500]) AS cell FROM customer),
        k AS (SELECT ud.node, CASE WHEN ud.cell // 65 IN (0, sy - 1) OR ud.cell % 65 IN (0, 64) THEN 3 WHEN kind = 1 THEN 2 WHEN kind = 2 AND lake_id <> own THEN 1 ELSE 0 END AS k FROM ud LEFT JOIN cells USING (cell) CROSS JOIN dim)
    SELECT node, ['land', 'other_lake', 'river_channel', 'map_edge'][max(k) + 1] AS kind FROM k GROUP BY node""",
        "dim",
        "cells",
    )
)
def spill_kinds(spark, sf_dir):
    cells, sy, sx = lattice(spark, sf_dir)
    key = F.col("c_custkey")
    saddles = table(spark, sf_dir, "customer").select(key.alias("node"), (key * 3 % 1500).alias("spill_cell"), (key * 7 % 1500).alias("outlet_cell"), (F.col("c_nationkey") % 8).alias("own_lake"))
    return walks.spill_kinds(saddles, cells, sy, sx)


@query(sql(" SELECT seg_id, code::BIGINT AS node FROM rivers LEFT JOIN cells ON row = y1 AND col = x1", "rivers", "cells"))
def end_nodes(spark, sf_dir):
    cells, _, _ = lattice(spark, sf_dir)
    r = rivers(spark, sf_dir)
    ends = r.select("seg_id", F.lit(0).alias("ord"), F.col("y0").alias("row"), F.col("x0").alias("col")).union(r.select("seg_id", F.lit(1), "y1", "x1"))
    return walks.end_nodes(ends, cells.select("row", "col", F.col("code").cast("long").alias("label")))


_CHANNEL = """, ds AS (SELECT r, c FROM (SELECT unnest([-2,-1,0,1,2]) AS r), (SELECT unnest([-2,-1,0,1,2]) AS c) WHERE r * r + c * c <= 4), sr AS (SELECT row, col, h FROM cells WHERE kind = 1 AND code < 8),
    nr AS (SELECT v.row, v.col, v.h, min((r * r + c * c) * 100000000::BIGINT + s.row * 1000 + s.col) AS k FROM cells v, ds JOIN sr s ON s.row = v.row + r AND s.col = v.col + c WHERE v.kind = 1 GROUP BY v.row, v.col, v.h),
    chan AS (SELECT v.row, v.col, (CASE WHEN k IS NOT NULL AND sqrt(k // 100000000) * 5 <= 3 + 5 THEN least(s.h, v.h + 1000000) ELSE v.h END)::DOUBLE AS level FROM cells v LEFT JOIN nr ON nr.row = v.row AND nr.col = v.col
        LEFT JOIN sr s ON s.row = (k % 100000000) // 1000 AND s.col = k % 1000 WHERE v.kind = 1)"""


def _channels(spark, sf_dir):
    cells, _, _ = lattice(spark, sf_dir)
    rows = cells.select("row", "col", F.col("h").cast("double").alias("h"), "kind", F.lit(3.0).alias("half_width"))
    return cells, walks.channel_levels(rows, cells.where("kind = 1 and code < 8"), 2, 5.0, 1e6)


@query(sql(_CHANNEL + " SELECT * FROM chan", "cells"))
def channel_levels(spark, sf_dir):
    return _channels(spark, sf_dir)[1]


@query(
    sql(
        _CHANNEL
        + """, lv AS (SELECT lake_id, (sum(h) // count(*))::DOUBLE AS level FROM cells WHERE lake_id BETWEEN 1 AND 4 GROUP BY lake_id), pb AS (SELECT n_nationkey AS lake_id, n_nationkey * 1000000.0::DOUBLE AS published FROM nation WHERE n_nationkey IN (2, 5, 6))
    SELECT cells.row, cells.col, coalesce(lv.level, published, chan.level) AS surface FROM cells LEFT JOIN lv USING (lake_id) LEFT JOIN pb USING (lake_id) LEFT JOIN chan ON chan.row = cells.row AND chan.col = cells.col""",
        "cells",
    )
)
def water_surface(spark, sf_dir):
    """Resolved levels before published ones, lakes before rivers."""
    cells, channel = _channels(spark, sf_dir)
    own = _levels(cells.where("lake_id between 1 and 4")).withColumn("level", F.col("level").cast("double"))
    known = table(spark, sf_dir, "nation").where("n_nationkey in (2, 5, 6)").select(F.col("n_nationkey").alias("lake_id"), (F.col("n_nationkey") * 1000000.0).alias("published"))
    return walks.water_surface(cells, channel, own.join(known, "lake_id", "full_outer"))


@query(
    sql(
        _PARENTS
        + """, l1 AS (SELECT prow AS row, pcol AS col, (min(code * 100000000 + cell) % 100000000)::BIGINT AS label, min(code) AS code FROM cells JOIN gc USING (col) JOIN gr USING (row) GROUP BY prow, pcol)
    SELECT 0 AS level, row, col, cell AS label FROM cells UNION ALL SELECT 1, row, col, label FROM l1""",
        "dim",
        "cells",
    )
)
def label_pyramid(spark, sf_dir):
    cells, sy, sx = lattice(spark, sf_dir)
    first = stencil.downsample_label(cells.withColumn("label", F.col("cell")), sy, sx).select(F.lit(1).alias("level"), "row", "col", "label")
    return cells.select(F.lit(0).alias("level"), "row", "col", F.col("cell").alias("label")).union(first)


@query(
    sql(
        """, p AS (SELECT cell AS id, row + 0.25 AS ar, col + 0.5 AS ac FROM cells), i AS (SELECT * FROM p, dim WHERE floor(ar) < sy - 1 AND floor(ac) < sx - 1),
        d AS (SELECT i.* FROM i JOIN cells n ON n.row = round_even(ar, 0) AND n.col = round_even(ac, 0) WHERE n.kind = 0)
    SELECT id, sum(h * (CASE WHEN cells.row = floor(ar) THEN 0.75 ELSE 0.25 END) * 0.5) AS h FROM d JOIN cells ON cells.row IN (floor(ar), floor(ar) + 1) AND cells.col IN (floor(ac), floor(ac) + 1) GROUP BY id HAVING count(*) = 4""",
        "dim",
        "cells",
    )
)
def dry_heights(spark, sf_dir):
    cells, sy, sx = lattice(spark, sf_dir)
    points = cells.select(F.col("cell").alias("id"), (F.col("row") + 0.25).alias("at_row"), (F.col("col") + 0.5).alias("at_col"))
    return downhill.dry_heights(points, cells, sy, sx).where("h is not null").select("id", F.col("h").alias("h"))


_PATH = "pa AS (SELECT row + 1 AS seg_id, col AS place, row, col, h AS bed, CASE WHEN lake_id > 0 THEN 1 ELSE 0 END AS mark FROM cells), sg AS (SELECT DISTINCT seg_id, CASE WHEN seg_id > 1 THEN seg_id // 2 END AS downstream FROM pa)"


@query(
    sql(
        f""", {_PATH}, en AS (SELECT seg_id, min(bed) AS low FROM pa GROUP BY seg_id),
        up(seg_id, pl) AS (SELECT seg_id, downstream FROM sg WHERE downstream IS NOT NULL UNION ALL SELECT up.seg_id, sg.downstream FROM up JOIN sg ON sg.seg_id = up.pl WHERE sg.downstream IS NOT NULL),
        cm AS (SELECT pl AS seg_id, min(low) AS came FROM up JOIN en USING (seg_id) GROUP BY pl), r AS (SELECT *, min(bed) OVER (PARTITION BY seg_id ORDER BY place) AS run FROM pa)
    SELECT row, col, least(run, came)::DOUBLE AS bed FROM r LEFT JOIN cm USING (seg_id) WHERE mark = 0""",
        "cells",
    )
)
def burned_paths(spark, sf_dir):
    """Rows of the lattice as lines that flow together two by two."""
    cells, _, _ = lattice(spark, sf_dir)
    path = cells.select((F.col("row") + 1).alias("seg_id"), F.col("col").alias("place"), "row", "col", F.col("h").alias("bed"), (F.col("lake_id") > 0).cast("int").alias("mark"))
    segments = path.select("seg_id").distinct().withColumn("downstream", F.when(F.col("seg_id") > 1, F.floor(F.col("seg_id") / 2).cast("int")))
    return downhill.burned_paths(path, segments)


@query()
def downhill_profiles(spark, sf_dir):
    """Users' lines as rivers that flow together two by two, with ground, banks and lakes."""
    rows = lines(spark, sf_dir).withColumn("seg_id", F.col("seg_id") + 1)
    segments = rows.select("seg_id").distinct().withColumn("downstream", F.when(F.col("seg_id") > 1, F.floor(F.col("seg_id") / 2)))
    order = downhill.flow_order(segments).select("seg_id", "downstream", "rank").withColumn("half_width", F.lit(4.0)).withColumn("carve", F.lit(2.0))
    along = Window.partitionBy("seg_id").orderBy("ord")
    vertices = rows.select("seg_id", (F.row_number().over(along) - 1).alias("ord"), "x", "y", (F.lit(300.0) + F.col("z") / 100 - F.col("ord")).alias("level"), F.when(F.col("z") % 3 > 0, F.lit(302.0) - F.col("ord") + F.col("z") % 50).alias("ceiling"), F.lit(None).cast("double").alias("trench"))
    spans = rows.where("lake_id > 0 and ord between 4 and 6").groupBy("seg_id").agg(F.min("ord").alias("a"), F.max("ord").alias("b"), F.lit(290.0).alias("level"))
    return downhill.profiles(downhill.lines_of(vertices, order, spans), 5.0)


@query(sql(", st AS (SELECT greatest(1, greatest(sy, sx) // 32)::INTEGER AS s FROM dim) SELECT (row // s)::INTEGER AS row, (col // s)::INTEGER AS col, h FROM cells, st WHERE row % s = 0 AND col % s = 0", "dim", "cells"))
def preview_samples(spark, sf_dir):
    cells, sy, sx = lattice(spark, sf_dir)
    return previews.thin(cells.select("row", "col", "h"), (sy, sx), 32)


@query(sql(" SELECT round(greatest(quantile_cont(abs(h - 10000000)::DOUBLE, 0.99), 0.001), 3) AS scale FROM cells WHERE abs(h - 10000000) > 0.001", "cells"))
def ramp_scale(spark, sf_dir):
    cells, _, _ = lattice(spark, sf_dir)
    return spark.createDataFrame([(round(previews.scale_of(cells.withColumn("d", (F.col("h") - 10000000).cast("double")), "d"), 3),)], "scale double")


@query(sql(" SELECT row, col, cell, (7200000 + (SELECT sy - 1 FROM dim) * 10.0 - row * 10.0)::DOUBLE AS y, (500000 + col * 10.0)::DOUBLE AS x, (500000 + col * 10.0 BETWEEN 500100 AND 500400) AND (7200000 + (SELECT sy - 1 FROM dim) * 10.0 - row * 10.0 BETWEEN 7200050 AND 7200100) AS inside FROM cells", "dim", "cells"))
def cell_places(spark, sf_dir):
    cells, sy, _ = lattice(spark, sf_dir)
    x, y = codecs.cell_xy(F.col("row"), F.col("col"), sy, 500000.0, 7200000.0, 10.0)
    placed = cells.select("row", "col", "cell", y.alias("y"), x.alias("x"))
    return placed.withColumn("inside", geometry.in_extent(F.col("x"), F.col("y"), (500100.0, 7200050.0, 500400.0, 7200100.0)))


@query(
    sql(
        """, rg AS (SELECT min(h) AS lo, max(h) AS hi FROM cells) SELECT row, col, round((h - lo)::DOUBLE / greatest(hi - lo, 1e-6) * 65535, 6) AS code FROM cells, rg""",
        "cells",
    )
)
def fractional_codes(spark, sf_dir):
    cells, _, _ = lattice(spark, sf_dir)
    low, high = cells.agg(F.min("h"), F.max("h")).first()
    return cells.select("row", "col", F.round(codecs.height_to_code(F.col("h"), F.lit(float(low or 0)), F.lit(float(high or 1))), 6).alias("code"))


@query(
    sql(
        _ADJ
        + """, w AS (SELECT row, col FROM cells WHERE kind = 0 AND code < 6), sd AS (SELECT w.row, w.col FROM w JOIN cells k ON k.row = w.row AND k.col = w.col WHERE k.code = 0),
        fl(row, col) AS (SELECT row, col FROM sd UNION SELECT w.row, w.col FROM fl, s8 JOIN w ON w.row = fl.row + r AND w.col = fl.col + c)
    SELECT row, col FROM fl""",
        "cells",
    )
)
def flooded_from(spark, sf_dir):
    """Samples that water from the lowest ones reaches over low land."""
    cells, _, sx = lattice(spark, sf_dir)
    return spatial.reached(cells.where("kind = 0 and code < 6").select("row", "col", (F.col("code") == 0).alias("seed")), sx)



@query(
    """WITH s AS (SELECT l_partkey AS vatnlnr, l_quantity - 25 AS maksdyp_m, l_orderkey * 10 + l_linenumber AS pos FROM lineitem),
    d AS (SELECT p_partkey AS vatnlnr FROM part WHERE p_size > 40 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)
    SELECT vatnlnr, maksdyp_m, pos FROM s WHERE maksdyp_m > 0 AND vatnlnr IN (SELECT vatnlnr FROM d) QUALIFY row_number() OVER (PARTITION BY vatnlnr ORDER BY pos) = 1"""
)
def candidate_lakes(spark, sf_dir):
    surveys = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("vatnlnr"), (F.col("l_quantity") - 25).alias("maksdyp_m"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    contours = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vatnlnr"), (F.col("p_size") - 40.0).alias("dybde_m"))
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vatnlnr"), (F.col("s_acctbal") - 5000).alias("dybde_m"))
    return fetch.candidate_lakes(surveys, contours, points).select("vatnlnr", "maksdyp_m", "pos")


@query("SELECT user_id AS id, min(event_id) AS pos, arg_min(event_type, event_id) AS kind FROM events GROUP BY user_id")
def first_features(spark, sf_dir):
    return fetch.first_of_each(table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.col("event_type").alias("kind")))


@query(
    sql(
        _ARCS
        + """, e AS (SELECT seg_id, arg_min(z, ord) + 100.0 AS fl, CASE WHEN seg_id % 3 > 0 THEN 500.0 END AS ll, CASE WHEN seg_id % 2 = 0 THEN 5 ELSE max(ord) END AS up FROM lines WHERE seg_id % 5 > 0 GROUP BY seg_id),
        t AS (SELECT ar.*, greatest(up, 1) AS upto, fl, ll, max(CASE WHEN ord <= greatest(up, 1) THEN arc END) OVER (PARTITION BY seg_id) AS tot, first_value(z) OVER w AS z0, last_value(z) OVER w AS z1 FROM ar JOIN e USING (seg_id) WINDOW w AS (PARTITION BY seg_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        u AS (SELECT *, CASE WHEN tot > 0 THEN arc / tot ELSE ord / upto END AS t FROM t)
    SELECT seg_id, ord, round(CASE WHEN ord <= upto THEN z + (fl - z0) * (1 - t) + coalesce(ll - z1, 0) * t ELSE z END, 4) AS level FROM u UNION ALL SELECT seg_id, ord, z FROM lines WHERE seg_id NOT IN (SELECT seg_id FROM e)""",
        "lines",
    )
)
def retied_levels(spark, sf_dir):
    rows = lines(spark, sf_dir).select("seg_id", "ord", "x", "y", F.lit(0.0).alias("z"), F.col("z").cast("double").alias("level"))
    own = rows.where("seg_id % 5 > 0").groupBy("seg_id").agg((F.min_by("level", "ord") + 100).alias("first_level"))
    ends = own.select("seg_id", "first_level", F.when(F.col("seg_id") % 3 > 0, 500.0).alias("last_level"), F.when(F.col("seg_id") % 2 == 0, 5).alias("upto"))
    return network.retied(rows, ends).select("seg_id", "ord", F.round("level", 4).alias("level"))


@query(
    sql(
        f""", {_LOW}, c AS (SELECT head - greatest(low - spill_m, 0) AS cut FROM tree JOIN low USING (node) WHERE NOT authored AND low IS NOT NULL AND head > greatest(low - spill_m, 0))
    SELECT count(*) AS heads_capped_below_a_lake, round(coalesce(median(cut), 0), 3) AS cap_median_m, round(coalesce(max(cut), 0), 3) AS cap_max_m FROM c""",
        "cells",
    )
)
def cap_report(spark, sf_dir):
    own = _own(spark, sf_dir).select(F.col("node").cast("long").alias("node"), "own")
    tree = _tree(spark, sf_dir)
    return trees.cap_report(tree.select("node", "head"), trees.capped_heads(tree, own))


@query(
    sql(
        """, ln AS (SELECT seg_id, x0, y0, x1, y1, sqrt(((x1 - x0) ^ 2 + (y1 - y0) ^ 2)::DOUBLE) AS len FROM rivers), nm AS (SELECT seg_id, x0, y0, x1, y1, CASE WHEN len > 0 THEN -(y1 - y0) / len ELSE 0 END AS nx, CASE WHEN len > 0 THEN (x1 - x0) / len ELSE 1 END AS ny FROM ln),
        vt AS (SELECT seg_id, 0 AS ord, x0 AS x, y0 AS y, nx, ny FROM nm UNION ALL SELECT seg_id, 1, x1, y1, nx, ny FROM nm),
        pt AS (SELECT *, row_number() OVER () AS id, x + nx * side * (0.6 + 0.70711 + more) AS ac, y + ny * side * (0.6 + 0.70711 + more) AS ar FROM vt, (SELECT unnest([-1, 1]) AS side), (SELECT unnest([0, 0.5, 1.0])::DOUBLE AS more)),
        i AS (SELECT pt.* FROM pt, dim WHERE ar >= 0 AND ac >= 0 AND floor(ar) < sy - 1 AND floor(ac) < sx - 1), d AS (SELECT i.* FROM i JOIN cells n ON n.row = round_even(ar, 0) AND n.col = round_even(ac, 0) WHERE n.kind = 0),
        b AS (SELECT id, any_value(seg_id) AS seg_id, any_value(ord) AS ord, sum(h * (1 - abs(ar - cells.row)) * (1 - abs(ac - cells.col))) AS h FROM d JOIN cells ON cells.row IN (floor(ar), floor(ar) + 1) AND cells.col IN (floor(ac), floor(ac) + 1) GROUP BY id HAVING count(*) = 4)
    SELECT seg_id, ord, round(min(h), 2) AS ceiling FROM b GROUP BY seg_id, ord""",
        "dim",
        "cells",
        "rivers",
    )
)
def bank_ceilings(spark, sf_dir):
    cells, sy, sx = lattice(spark, sf_dir)
    r = rivers(spark, sf_dir)
    ends = r.select("seg_id", F.lit(0).alias("ord"), F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y")).union(r.select("seg_id", F.lit(1), F.col("x1").cast("double"), F.col("y1").cast("double")))
    got = downhill.bank_ceilings(ends.withColumn("half_width", F.lit(3.0)), cells, sy, sx, 5.0)
    return got.where("ceiling is not null").select("seg_id", "ord", F.round("ceiling", 2).alias("ceiling"))


@query(
    sql(
        """, ds AS (SELECT r, c FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS r), (SELECT unnest([-2, -1, 0, 1, 2]) AS c) WHERE r * r + c * c <= 4), wd AS (SELECT r, c FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS r), (SELECT unnest([-2, -1, 0, 1, 2]) AS c)),
        sr AS (SELECT row, col, h FROM cells WHERE kind = 1 AND code < 8), nr AS (SELECT v.row, v.col, min((r * r + c * c) * 100000000::BIGINT + s.row * 1000 + s.col) AS k FROM cells v, ds JOIN sr s ON s.row = v.row + r AND s.col = v.col + c WHERE v.kind = 1 GROUP BY v.row, v.col),
        hi AS (SELECT v.row, v.col, max(o.h) AS high FROM cells v, wd JOIN cells o ON o.row = v.row + r AND o.col = v.col + c WHERE v.kind = 1 GROUP BY v.row, v.col)
    SELECT nr.row, nr.col, (s.h - 1000)::DOUBLE AS level, CASE WHEN v.h - 50000 > greatest(s.h - 600000, high - 5000000) THEN greatest(s.h - 600000, high - 5000000)::DOUBLE END AS target
    FROM nr JOIN cells v ON v.row = nr.row AND v.col = nr.col JOIN hi ON hi.row = nr.row AND hi.col = nr.col JOIN sr s ON s.row = (k % 100000000) // 1000 AND s.col = k % 1000 WHERE sqrt(k // 100000000) * 5 <= 8""",
        "cells",
    )
)
def river_bed(spark, sf_dir):
    """The river samples of the lower codes stand for vertices of shaped lines."""
    cells, _, _ = lattice(spark, sf_dir)
    rows = cells.select("row", "col", F.col("h").cast("double").alias("h"), "kind", F.lit(3.0).alias("half_width"), F.lit(50000.0).alias("depth"), F.col("h").cast("double").alias("level"))
    vertices = cells.where("kind = 1 and code < 8").select("row", "col", (F.col("h") - 1000).cast("double").alias("surface"), (F.col("h") - 600000).cast("double").alias("bed"))
    return downhill.river_bed(rows, vertices, 5.0, 2, most_m=5e6)


@query(
    sql(
        _WAYS
        + """, st AS (SELECT seg_id, a.cell, b.cell AS fin FROM rivers JOIN cells a ON a.row = y0 AND a.col = x0 JOIN cells b ON b.row = y1 AND b.col = x1),
        wk(seg_id, cell, fin, steps, status) AS (SELECT seg_id, cell, fin, 0, NULL::INTEGER FROM st
        UNION ALL SELECT wk.seg_id, CASE WHEN s IS NULL THEN n.nxt ELSE wk.cell END, fin, steps + CASE WHEN s IS NULL THEN 1 ELSE 0 END, s FROM wk LEFT JOIN nx n ON n.cell = wk.cell JOIN cells ON cells.cell = wk.cell CROSS JOIN dim,
            LATERAL (SELECT CASE WHEN (abs(cells.row - fin // 65) <= 1 AND abs(cells.col - fin % 65) <= 1) OR cells.row IN (0, sy - 1) OR cells.col IN (0, sx - 1) OR steps >= 40 THEN 0 WHEN kind = 0 THEN 1 WHEN n.nxt IS NULL THEN CASE WHEN code < 4 THEN 2 ELSE 3 END END AS s) WHERE status IS NULL)
    SELECT seg_id, status, cell, steps::INTEGER AS steps FROM wk WHERE status IS NOT NULL""",
        "dim",
        "cells",
        "rivers",
    )
)
def river_walks(spark, sf_dir):
    """Made-up flow codes; land is outside the corridor."""
    cells, sy, sx = lattice(spark, sf_dir)
    edge = F.col("row").isin(0, sy - 1) | F.col("col").isin(0, sx - 1)
    grid = cells.select("cell", "row", "col", (F.floor(F.col("h") / 1000) % 9).cast("int").alias("flow"), edge.alias("stop"), (F.col("kind") > 0).alias("corridor"), (F.col("code") < 4).alias("pit"))
    # A cell that flows to where there is no sample goes nowhere.
    there = grid.select(F.col("cell").alias("to"))
    r, c = walks._next_cell(F.col("flow"))
    lead = grid.select("cell", F.when((F.col("flow") > 0) & c.between(0, sx - 1), r.cast("long") * sx + c).alias("to")).join(there, "to", "left_semi").select("cell", F.lit(True).alias("on"))
    grid = grid.join(lead, "cell", "left").withColumn("flow", F.when(F.col("on"), F.col("flow")).otherwise(0)).drop("on")
    at = lambda y, x, name: cells.select(F.col("row").alias(y), F.col("col").alias(x), F.col("cell").alias(name))
    starts = rivers(spark, sf_dir).join(at("y0", "x0", "cell"), ["y0", "x0"]).join(at("y1", "x1", "end_cell"), ["y1", "x1"]).select("seg_id", "cell", "end_cell", F.lit(40).alias("most"))
    return walks.river_walks(starts, grid, sx).select("seg_id", "status", "cell", "steps")


@query(
    sql(
        _ADJ
        + """, ar AS (SELECT row, col, cell FROM cells WHERE code < 5 AND kind <> 2 AND code > 0), pr AS (SELECT a.cell AS a, b.cell AS b FROM ar a, s8 JOIN ar b ON b.row = a.row + r AND b.col = a.col + c),
        cl(a, b) AS (SELECT cell, cell FROM ar UNION SELECT cl.a, pr.b FROM cl JOIN pr ON pr.a = cl.b), cp AS (SELECT a AS cell, min(b) AS piece FROM cl GROUP BY a), big AS (SELECT piece FROM cp GROUP BY piece HAVING count(*) * 400 >= 1500)
    SELECT row, col, piece FROM cp JOIN big USING (piece) JOIN ar USING (cell)""",
        "cells",
    )
)
def undrawn_pieces(spark, sf_dir):
    cells, _, sx = lattice(spark, sf_dir)
    return branches.undrawn_pieces(cells.where("code < 5"), cells.where("code = 0"), cells.where("kind = 2"), sx, 20.0)


@query(
    sql(
        """, lv AS (SELECT lake_id, (sum(h) // count(*))::DOUBLE AS level, count(*) AS own FROM cells WHERE kind = 2 GROUP BY lake_id),
        ds AS (SELECT r, c FROM (SELECT unnest([-4, -3, -2, -1, 0, 1, 2, 3, 4]) AS r), (SELECT unnest([-4, -3, -2, -1, 0, 1, 2, 3, 4]) AS c) WHERE r * r + c * c <= 16),
        lo AS (SELECT a.row, a.col, a.cell, l.lake_id AS lake, min(r * r + c * c) AS d2 FROM cells a, ds JOIN cells l ON l.row = a.row + r AND l.col = a.col + c JOIN lv ON lv.lake_id = l.lake_id WHERE a.kind = 0 AND l.kind = 2 AND a.h < level GROUP BY ALL),
        s8 AS (SELECT r, c FROM (SELECT unnest([-1, 0, 1]) AS r), (SELECT unnest([-1, 0, 1]) AS c) WHERE r <> 0 OR c <> 0),
        pr AS (SELECT a.lake, a.cell AS a, b.cell AS b FROM lo a, s8 JOIN lo b ON b.lake = a.lake AND b.row = a.row + r AND b.col = a.col + c),
        cl(lake, a, b) AS (SELECT lake, cell, cell FROM lo UNION SELECT cl.lake, cl.a, pr.b FROM cl JOIN pr ON pr.lake = cl.lake AND pr.a = cl.b), cp AS (SELECT lake, a AS cell, min(b) AS comp FROM cl GROUP BY lake, a),
        ok AS (SELECT cp.lake, comp FROM cp JOIN lo ON lo.lake = cp.lake AND lo.cell = cp.cell JOIN lv ON lv.lake_id = cp.lake CROSS JOIN dim GROUP BY cp.lake, comp
               HAVING min(d2) < 2.25 AND max(sqrt(d2)) * 5 <= 12 AND NOT bool_or(row IN (0, sy - 1) OR col IN (0, sx - 1)) AND count(*) <= any_value(own))
    SELECT row, col, min(cp.lake)::INTEGER AS lake_id FROM cp JOIN ok ON ok.lake = cp.lake AND ok.comp = cp.comp JOIN lo ON lo.lake = cp.lake AND lo.cell = cp.cell GROUP BY row, col""",
        "dim",
        "cells",
    )
)
def low_ground(spark, sf_dir):
    cells, sy, sx = lattice(spark, sf_dir)
    levels = _levels(cells).withColumn("level", F.col("level").cast("double"))
    return shores.low_ground(cells, levels, sy, sx, 5.0, most_m=12.0 - 1e-9).select("row", "col", F.col("lake_id").cast("int").alias("lake_id"))


@query(
    sql(
        """, ed AS (SELECT seg_id AS area, unnest([x0 * 10, x1 * 10 + 10, (x0 + x1) // 2 * 10])::DOUBLE AS ax, unnest([y0 * 10 + 5, y1 * 10 + 2.5, (y0 + y1) // 2 * 10 + 97.5])::DOUBLE AS ay, unnest([x1 * 10 + 10, (x0 + x1) // 2 * 10, x0 * 10])::DOUBLE AS bx, unnest([y1 * 10 + 2.5, (y0 + y1) // 2 * 10 + 97.5, y0 * 10 + 5])::DOUBLE AS bb FROM rivers),
        ry AS (SELECT seg_id AS ray, (x0 * 10 + x1 * 10 + 10 + (x0 + x1) // 2 * 10) / 3.0::DOUBLE AS x, (y0 * 10 + 5 + y1 * 10 + 2.5 + (y0 + y1) // 2 * 10 + 97.5) / 3.0::DOUBLE AS y FROM rivers),
        dr AS (SELECT ray, x, y, d, CASE d WHEN 0 THEN 0.6 ELSE 0.8 END::DOUBLE AS ux, CASE d WHEN 0 THEN 0.8 ELSE -0.6 END::DOUBLE AS uy FROM ry, (SELECT unnest([0, 1]) AS d)),
        sd AS (SELECT dr.*, ed.*, ux * (ay - y) - uy * (ax - x) AS s0, ux * (bb - y) - uy * (bx - x) AS s1 FROM dr, ed),
        ct AS (SELECT DISTINCT ray, d, area, (ax + (bx - ax) * (s0 / (s0 - s1)) - x) * ux + (ay + (bb - ay) * (s0 / (s0 - s1)) - y) * uy AS t FROM sd WHERE (s0 <= 0) <> (s1 <= 0)),
        cr AS (SELECT * FROM ct WHERE abs(t) <= 600), ins AS (SELECT ray, area FROM cr WHERE d = 0 AND t > 0 GROUP BY ray, area HAVING count(*) % 2 = 1),
        ch AS (SELECT i.ray, i.area, dd.d, coalesce(max(CASE WHEN t <= 0 THEN t END), -600) AS lo, coalesce(min(CASE WHEN t > 0 THEN t END), 600) AS hi FROM ins i CROSS JOIN (SELECT unnest([0, 1]) AS d) dd LEFT JOIN cr ON cr.ray = i.ray AND cr.area = i.area AND cr.d = dd.d GROUP BY ALL),
        w AS (SELECT a.ray, a.area, a.hi - a.lo AS wide, (a.lo + a.hi) / 2 AS mid FROM ch a JOIN ch b ON a.ray = b.ray AND a.area = b.area AND a.d = 0 AND b.d = 1 WHERE b.hi - b.lo >= 0.75 * (a.hi - a.lo)),
        tt AS (SELECT w.*, ry.x, ry.y, ax, ay, bx, bb, greatest(0, least(1, ((ry.x - ax) * (bx - ax) + (ry.y - ay) * (bb - ay)) / greatest((bx - ax) ^ 2 + (bb - ay) ^ 2, 1e-12))) AS u FROM w JOIN ry USING (ray) JOIN ed USING (area)),
        bk AS (SELECT ray, area, wide, mid, greatest(sqrt(min((ax + (bx - ax) * u - x) ^ 2 + (ay + (bb - ay) * u - y) ^ 2)) * 4, 1) AS cap FROM tt GROUP BY ray, area, wide, mid)
    SELECT ray, round(least(wide, cap), 3) AS width, CASE WHEN wide <= cap THEN round(mid, 3) END AS middle FROM bk QUALIFY row_number() OVER (PARTITION BY ray ORDER BY wide, area) = 1""",
        "rivers",
    )
)
def measured_widths(spark, sf_dir):
    """Triangles stand for mapped areas, their centres for vertices."""
    r = rivers(spark, sf_dir)
    mid = F.floor((F.col("x0") + F.col("x1")) / 2) * 10, F.floor((F.col("y0") + F.col("y1")) / 2) * 10 + 97.5
    corners = [(F.col("x0") * 10, F.col("y0") * 10 + 5), (F.col("x1") * 10 + 10, F.col("y1") * 10 + 2.5), mid]
    sides = [F.struct(*(v.cast("double").alias(n) for v, n in zip((*a, *b), ("x0", "y0", "x1", "y1"), strict=True))) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    edges = r.select(F.col("seg_id").alias("area"), F.explode(F.array(*sides)).alias("e")).select("area", "e.*")
    centre = [sum((c[k] for c in corners[1:]), corners[0][k]) / 3 for k in (0, 1)]
    rays = r.select(F.col("seg_id").alias("ray"), centre[0].cast("double").alias("x"), centre[1].cast("double").alias("y"), F.lit(0.6).alias("ux"), F.lit(0.8).alias("uy"))
    got = geometry.measured_widths(rays, edges, geometry.WidthRules(half_width_m=600.0))
    return got.select("ray", F.round("width", 3).alias("width"), F.round("middle", 3).alias("middle"))
