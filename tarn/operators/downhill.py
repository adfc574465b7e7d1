"""Rivers that never run uphill: an order from the sources down, profiles shaped under their banks, graded onto junctions and lakes, and burned into the bed.

A line is one row with arrays, which its own length bounds, and what happens along it is a kernel over that row. What passes between lines goes
through tables, a rank of the network at a time: first from the sources down (a line may not begin above what flows into it), then
from the mouths up (a tributary's tail meets the river that it joins).

Lines: ``seg_id, downstream, rank, x, y, level`` (ground along it)``, ceiling`` (lowest dry bank; infinite: none)``, trench`` (how deep it may go)``, spans``
(``a, b, level`` of lakes, by ``a``)``, half_width, carve`` (its depth).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import hydraulics
from tarn.operators import stencil
from tarn.operators.measures import normals
from tarn.runtime import written


@dataclass(frozen=True)
class Rules:
    """Grades, tapers, what counts as a barrier, a fall, a flat, a backwater."""

    grade: float = 0.30
    taper: int = 4
    barrier_m: float = 5.0
    barrier_length_m: float = 40.0
    flank_m: float = 1.0
    barrier_rounds: int = 8
    over_bank_m: float = 1.0
    fall_slope: float = 0.35
    context: int = 2
    sunk_m: float = 10.0
    tilt_m: float = 0.011
    flat_m: float = 0.01
    tail: int = 30
    step_m: float = 0.5


# --------------------------------------------------------------------------- order


def link_ranks(segments: DataFrame) -> DataFrame:
    """``seg_id, downstream, rank, cyclic``: the longest chain of lines above each one, 0 at sources; members of cycles, and what hangs on them, come after all others.

    Chains are measured by doubling: after k rounds a line knows the longest chain above it of under 2**k links.
    """
    known = segments.select(F.col("seg_id").alias("downstream"), F.lit(True).alias("there"))
    linked = segments.select("seg_id", "downstream").join(known, "downstream", "left").select("seg_id", F.when(F.col("there"), F.col("downstream")).alias("downstream"))
    linked = written(linked, "links")
    many = linked.count()
    now = written(linked.select("seg_id", F.col("downstream").alias("to"), F.lit(0).cast("long").alias("rank")), "ranks")
    reach = 1
    while reach <= many and not now.where("to is not null").isEmpty():
        sent = now.where("to is not null").groupBy(F.col("to").alias("seg_id")).agg((F.max("rank") + reach).alias("more"))
        ahead = now.select(F.col("seg_id").alias("to"), F.col("to").alias("then"))
        both = now.join(sent, "seg_id", "left").join(ahead, "to", "left")
        now = written(both.select("seg_id", F.col("then").alias("to"), F.greatest("rank", "more").alias("rank")), "ranks")
        reach *= 2
    # A chain in a network without cycles has fewer links than there are lines.
    cyclic = F.col("rank") >= many
    return linked.join(now, "seg_id").select("seg_id", "downstream", F.when(~cyclic, F.col("rank")).otherwise(F.lit(many)).alias("rank"), cyclic.alias("cyclic"))


def flow_order(segments: DataFrame) -> DataFrame:
    """``seg_id, downstream, rank, cyclic`` with ranks without gaps: an order in which every line comes after all that flow into it, cycles last.

    A chain of some length has all shorter ones within, so only the rank of the cycles has to be moved up.
    """
    ranks = written(link_ranks(segments), "ranks")
    top = ranks.where("not cyclic").agg(F.max("rank")).first()[0]
    return ranks.withColumn("rank", F.when(F.col("cyclic"), F.lit(0 if top is None else top + 1)).otherwise(F.col("rank")))


# --------------------------------------------------------------------------- banks


def half_width(order: Column, spacing_m: float, width: Column, scale: float = 1.0) -> Column:
    """Half a line's own width where it is known and positive, else half its order's; half a cell at least."""
    own = F.when((width > 0) & (width < float("inf")), width).otherwise(hydraulics.by_order(order, hydraulics.WIDTH_BY_ORDER, scale))
    return F.greatest(own / 2, F.lit(spacing_m / 2))


def dry_heights(points: DataFrame, cells: DataFrame, sy: int, sx: int, key: str = "id") -> DataFrame:
    """``key, h``: bilinear ground at points (``key, at_row, at_col``) whose nearest sample is land and whose four samples all have a height; others have none."""
    inside = points.where((F.col("at_row") >= 0) & (F.col("at_col") >= 0) & (F.floor("at_row") < sy - 1) & (F.floor("at_col") < sx - 1))
    nearest = inside.select(key, "at_row", "at_col", F.rint("at_row").cast("int").alias("row"), F.rint("at_col").cast("int").alias("col"))
    dry = nearest.join(cells.where("kind = 0").select("row", "col"), ["row", "col"], "left_semi").select(key, "at_row", "at_col")
    corner = lambda i, j: F.struct((F.floor("at_row") + i).cast("int").alias("row"), (F.floor("at_col") + j).cast("int").alias("col"))
    each = dry.select(key, F.explode(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))).alias("c")).select(key, "c.row", "c.col")
    whole = each.join(cells.where("h is not null").select("row", "col"), ["row", "col"], "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n = 4").select(key)
    return stencil.bilinear(dry.join(whole, key, "left_semi"), cells, sy, sx, key=key)


#: How far the edge of a stamped channel reaches beyond its width, in cells; a fixed value.
EDGE_CELLS = 0.70711


def bank_ceilings(vertices: DataFrame, cells: DataFrame, sy: int, sx: int, spacing_m: float) -> DataFrame:
    """``seg_id, ord, ceiling``: the lowest dry ground beside a vertex: on both sides, at the edge of the channel's strip and half a cell and a cell beyond; null: none is dry.

    Vertices: ``seg_id, ord, x, y`` (in cells: column and row from the north)``, half_width`` (metres).
    """
    # Rows run southwards, so the normal of the lattice's own axes is as good as that of the world's.
    across = normals(vertices.select("seg_id", "ord", "x", "y")).select("seg_id", "ord", F.coalesce("nx", F.lit(0.0)).alias("nx"), F.coalesce("ny", F.lit(1.0)).alias("ny"))
    edge = F.greatest(F.col("half_width") / spacing_m, F.lit(0.5)) + EDGE_CELLS
    offsets = F.array(*(edge * side + side * more for side in (-1, 1) for more in (0.0, 0.5, 1.0)))
    rows = vertices.join(across, ["seg_id", "ord"]).select("seg_id", "ord", "x", "y", "nx", "ny", F.posexplode(offsets).alias("k", "off"))
    key = F.struct("seg_id", "ord", "k")
    points = rows.select(key.alias("id"), (F.col("y") + F.col("ny") * F.col("off")).alias("at_row"), (F.col("x") + F.col("nx") * F.col("off")).alias("at_col"))
    found = dry_heights(points, cells, sy, sx).groupBy("id.seg_id", "id.ord").agg(F.min("h").alias("ceiling"))
    return vertices.select("seg_id", "ord").join(found, ["seg_id", "ord"], "left")


# --------------------------------------------------------------------------- along a line


def shaped(level: np.ndarray, ceiling: np.ndarray, radius: int, seed: float = np.inf) -> np.ndarray:
    """A profile that never rises, from ``seed`` on, under level and ceiling: the running minimum, smoothed by a mean whose width shrinks towards both ends."""
    cap = np.minimum(level, ceiling)
    n = len(cap)
    run = np.minimum.accumulate(np.minimum(cap, seed))
    with np.errstate(invalid="ignore"):
        total = np.concatenate([[0.0], np.cumsum(run)])
        i = np.arange(n)
        w = np.minimum(np.minimum(i, n - 1 - i), radius)
        mean = (total[i + w + 1] - total[i - w]) / (2 * w + 1)
    return np.minimum.accumulate(np.fmin(np.minimum(cap, seed), mean))


def flank(cap: np.ndarray) -> np.ndarray:
    """A profile that never falls below what lies ahead: the running minimum from the far end."""
    return np.fmin.accumulate(cap[::-1])[::-1]


def shaped_between(level: np.ndarray, ceiling: np.ndarray, radius: int, seed: float, barriers: list[tuple[int, int]]) -> np.ndarray:
    """``shaped`` from each barrier's crest anew. A barrier is (first, crest): its flank keeps the ground's own fall back towards ``first``."""
    out = np.empty(len(level))
    start = 0
    for first, crest in barriers:
        if crest <= start:
            continue
        first = max(first, start)
        out[start:first] = shaped(level[start:first], ceiling[start:first], radius, seed)
        out[first : crest + 1] = flank(np.minimum(level, ceiling)[first : crest + 1])
        start, seed = crest, np.inf
    out[start:] = shaped(level[start:], ceiling[start:], radius, seed)
    return out


def _stretches(mask: np.ndarray) -> list[tuple[int, int]]:
    turns = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def ridges(cap: np.ndarray, surface: np.ndarray, step: np.ndarray, open_: np.ndarray, rules: Rules) -> list[tuple[int, int]]:
    """(first, crest) of what a profile cuts too deep for too long, outside lakes."""
    with np.errstate(invalid="ignore"):
        cut = np.where(open_ & np.isfinite(cap - surface), cap - surface, -np.inf)
    shallow = np.flatnonzero(cut <= rules.flank_m)
    out: list[tuple[int, int]] = []
    for a, b in _stretches(cut > rules.barrier_m):
        if step[a:b].sum() <= rules.barrier_length_m:
            continue
        crest = a + int(np.argmax(cap[a:b]))
        before = shallow[shallow < a]
        first = int(before[-1]) + 1 if len(before) else 0
        if out:
            first = max(first, out[-1][1] + 1)
        if first < crest:
            out.append((first, crest))
    return out


def _joined(one: list[tuple[int, int]], two: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Barriers of both lists by their crests, none reaching back over the one before."""
    out: list[tuple[int, int]] = []
    for first, crest in sorted({*one, *two}, key=lambda b: (b[1], b[0])):
        if out and crest <= out[-1][1]:
            continue
        first = max(first, out[-1][1] + 1) if out else first
        if first < crest:
            out.append((first, crest))
    return out


def shape_line(level: np.ndarray, ceiling: np.ndarray, step: np.ndarray, open_: np.ndarray, radius: int, seed: float, rules: Rules = Rules()) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A line's profile and its barriers: each restart may show the next ridge, so it is looked for again until none is new."""
    barriers: list[tuple[int, int]] = []
    surface = shaped(level, ceiling, radius, seed)
    for _ in range(rules.barrier_rounds):
        more = _joined(barriers, ridges(np.minimum(level, ceiling), surface, step, open_, rules))
        if more == barriers:
            break
        barriers = more
        surface = shaped_between(level, ceiling, radius, seed, barriers)
    return surface, barriers


def graded(surface: np.ndarray, arc: np.ndarray, first: int, last: int, junction: float, touch_m: float, most: float, rules: Rules = Rules(), taper: int | None = None) -> np.ndarray:
    """The vertices ``first`` to ``last`` lowered onto a junction behind ``last``: at no more than the grade, by no more than ``most``; where that ends, what is lowered runs out over ``taper`` vertices."""
    if last < first or not np.isfinite(junction):
        return surface
    own = surface[first : last + 1]
    bound = junction + rules.grade * np.maximum(arc[last] - arc[first : last + 1] - touch_m, 0)
    too_far = np.flatnonzero(own - bound > max(most, 0) + 1e-9)
    if len(too_far):
        stop, taper = int(too_far[-1]), rules.taper if taper is None else taper
        begin = max(0, stop - taper)
        place = np.arange(len(own))
        share = np.clip((place - begin) / (stop - begin), 0, 1) if begin < stop else (place >= stop).astype(float)
        bound = np.maximum(bound, own - max(most, 0) * share)
    out = surface.copy()
    out[first : last + 1] = np.minimum(own, bound)
    return out


def backwater(surface: np.ndarray, ceiling: np.ndarray, first: int, last: int, lake: float, rules: Rules = Rules()) -> tuple[np.ndarray, bool]:
    """The low mouth before a lake raised to its level, as far up as the line lies below it and the bank isn't much lower; and whether that reaches beyond ``first``."""
    below = (surface[first : last + 1] < lake - 1e-9) & ~(ceiling[first : last + 1] < lake - rules.over_bank_m)
    dry = np.flatnonzero(~below)
    begin = first + (int(dry[-1]) + 1 if len(dry) else 0)
    out = surface.copy()
    out[begin : last + 1] = lake
    return out, begin == first and last >= first


def floors(own: np.ndarray, raw: np.ndarray, ceiling: np.ndarray, trench: np.ndarray, most: float, rules: Rules = Rules()) -> np.ndarray:
    """How low a profile may be made: by ``most`` at once, not under the ground's own running minimum less ``most``, not sunk under its banks, not below the trench; never above what it is."""
    ahead = lambda v: np.maximum.accumulate(v[::-1])[::-1]
    bank = ahead(np.where(np.isfinite(ceiling), ceiling - rules.sunk_m, -np.inf))
    limits = (np.minimum.accumulate(raw - most), bank, ahead(trench))
    return np.maximum.reduce([own - most, *(np.minimum(own, v) for v in limits)])


def softened(surface: np.ndarray, raw: np.ndarray, ceiling: np.ndarray, trench: np.ndarray, arc: np.ndarray, open_: np.ndarray, most: float, stride_m: float, rules: Rules = Rules()) -> np.ndarray:
    """Falls on gentle ground begin earlier: from the foot of a fall the grade is followed upwards, as far as the floors allow. Steep ground keeps its falls, and no ramp crosses a lake."""
    out = surface.copy()
    for a, b in _stretches(open_):
        if b - a < 2:
            continue
        own = surface[a:b]
        low = floors(own, raw[a:b], ceiling[a:b], trench[a:b], most, rules)
        made = own.copy()
        for k in np.flatnonzero(own[:-1] - own[1:] > rules.fall_slope * stride_m)[::-1]:
            left, right = max(a, a + k - rules.context), min(b - 1, a + k + 1 + rules.context)
            length = arc[right] - arc[left]
            if length <= 1e-9 or abs(raw[left] - raw[right]) / length > rules.fall_slope:
                continue
            for j in range(k, -1, -1):
                wanted = max(made[j + 1] + rules.grade * stride_m, low[j])
                if wanted >= made[j] - 1e-12:
                    break
                made[j] = wanted
        out[a:b] = made
    return out


def tilted(surface: np.ndarray, raw: np.ndarray, ceiling: np.ndarray, trench: np.ndarray, open_: np.ndarray, most: float, rules: Rules = Rules()) -> np.ndarray:
    """Flats within a line lean into the fall behind them, by a little for each vertex and no lower than the floors; flats that reach an end of a stretch are left."""
    out = surface.copy()
    for a, b in _stretches(open_):
        if b - a < 2:
            continue
        own = surface[a:b]
        low = floors(own, raw[a:b], ceiling[a:b], trench[a:b], most, rules)
        made = own.copy()
        for q, end in _stretches(own[:-1] - own[1:] < rules.flat_m):
            if end >= len(own) - 1:
                continue
            attempt = made.copy()
            for j in range(q + 1, end + 1):
                wanted = attempt[j - 1] - rules.tilt_m
                if attempt[j] > wanted + 1e-12:
                    attempt[j] = max(wanted, low[j])
            if not (np.diff(attempt) > 1e-12).any():
                made = attempt
        out[a:b] = made
    return out


def tied(arc: np.ndarray, start: float, end: float, upto: int) -> np.ndarray:
    """A side channel's level: from its river's at the split evenly down to where it ends, which it keeps from vertex ``upto`` on."""
    end, upto = min(start, end), max(upto, 1)
    share = arc[: upto + 1] / arc[upto] if arc[upto] > 0 else np.linspace(0, 1, upto + 1)
    return np.concatenate([start + (end - start) * share, np.full(len(arc) - upto - 1, end)])


# --------------------------------------------------------------------------- the network


def _line(row: dict) -> dict:
    """A row's arrays, and what follows from its shape."""
    a = {c: np.array([np.inf if v is None else v for v in row[c]], float) for c in ("x", "y", "level", "ceiling")}
    a["trench"] = np.array([-np.inf if v is None else v for v in row["trench"]], float)
    step = np.append(np.hypot(np.diff(a["x"]), np.diff(a["y"])), 0.0)
    open_ = np.ones(len(step), bool)
    for s in row["spans"]:
        open_[s["a"] : s["b"] + 1] = False
    return a | {"step": step, "arc": np.concatenate([[0.0], np.cumsum(step[:-1])]), "open": open_}


def _capped(n: int, spans: list[dict], cap: float) -> tuple[np.ndarray, float]:
    """The lowest lake level above each vertex, from ``cap`` of the lines above on; and what the line passes on."""
    out = np.full(n, cap)
    for s in spans:
        if s["level"] is not None:
            out[s["b"] + 1 :] = np.minimum(out[s["b"] + 1 :], s["level"])
            cap = min(cap, s["level"])
    return out, cap


_FROM_ABOVE = "seg_id long, downstream long, rank long, surface array<double>, caps array<double>, barriers array<array<int>>, last double, cap double"


def profiles(lines: DataFrame, spacing_m: float, rules: Rules = Rules()) -> DataFrame:
    """``seg_id, surface`` (an array along the line)``, bed, barriers``: levels that fall from the sources to the mouths, and the bed a line's own depth below.

    From the sources down, rank by rank: a line begins no higher than the lowest end that flows into it, and runs no higher than a lake behind it.
    Then from the mouths up: it is graded onto the lakes it enters, and its tail onto the river it joins; a lake's level is kept up its low
    mouth. Last, gentle falls are softened and inner flats tilted. Ranks are as many rounds, and no more of the network than one rank is in work.
    """
    lines = written(lines, "lines")
    top = lines.agg(F.max("rank")).first()[0]
    if top is None:
        return lines.select("seg_id", F.col("level").alias("surface"), F.col("level").alias("bed"), F.expr("cast(array() as array<array<int>>)").alias("barriers"))

    def down(batches):
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                a = _line(row)
                n = len(a["x"])
                radius = min(6, max(2, int(np.ceil(row["half_width"] / spacing_m))))
                seed = np.inf if row["seed"] is None else row["seed"]
                surface, barriers = shape_line(a["level"], a["ceiling"], a["step"], a["open"], radius, seed, rules)
                caps, cap = _capped(n, row["spans"], np.inf if row["cap"] is None else row["cap"])
                surface = np.fmin(surface, caps)
                made.append({"seg_id": row["seg_id"], "downstream": row["downstream"], "rank": row["rank"], "surface": surface.tolist(), "caps": caps.tolist(), "barriers": [list(b) for b in barriers], "last": float(surface[-1]), "cap": cap})
            yield pa.RecordBatch.from_pylist(made, schema=_schema(_FROM_ABOVE))

    done = None
    for rank in range(top + 1):
        own = lines.where(F.col("rank") == rank)
        if done is None:
            fed = own.withColumn("seed", F.lit(None).cast("double")).withColumn("cap", F.lit(None).cast("double"))
        else:
            ends = done.where("downstream is not null").groupBy(F.col("downstream").alias("seg_id")).agg(F.min("last").alias("seed"), F.min("cap").alias("cap"))
            fed = own.join(ends, "seg_id", "left")
        part = written(fed.mapInArrow(down, _FROM_ABOVE), "rank")
        done = part if done is None else done.unionByName(part)
    shaped_lines = written(lines.drop("downstream", "rank").join(done, "seg_id"), "shaped")

    kind = "seg_id long, downstream long, surface array<double>, first double, flooded boolean, half_width double"

    def up(batches):
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                a = _line(row)
                surface, ceiling, caps = np.array(row["surface"]), a["ceiling"], np.array(row["caps"])
                spans, flooded, n = row["spans"], False, len(a["x"])
                if row["join"] is not None:
                    begin = max((s["b"] + 1 for s in spans if s["b"] < n - 1), default=0)
                    level = min(row["join"], caps[-1])
                    if np.isfinite(level):
                        surface = graded(surface, a["arc"], begin, n - 1, level, row["half_width"] + row["other_half"] + spacing_m, row["carve"], rules)
                        if row["join_flooded"] and surface[-1] < level - 1e-9:
                            surface, over = backwater(surface, ceiling, begin, n - 1, level, rules)
                            flooded |= over and begin == 0
                for k in range(len(spans) - 1, -1, -1):
                    at, lake = spans[k]["a"], spans[k]["level"]
                    if at <= 0 or lake is None:
                        continue
                    begin, lake = (spans[k - 1]["b"] + 1 if k else 0), min(lake, caps[at - 1])
                    surface = graded(surface, a["arc"], begin, at - 1, lake, row["half_width"] + spacing_m, row["carve"], rules)
                    if surface[at - 1] < lake - 1e-9:
                        surface, over = backwater(surface, ceiling, begin, at - 1, lake, rules)
                        flooded |= over and begin == 0
                lake = next((s["level"] for s in spans if s["a"] == 0), None)
                first = float(surface[0]) if lake is None else lake
                made.append({"seg_id": row["seg_id"], "downstream": row["downstream"], "surface": surface.tolist(), "first": first, "flooded": flooded or lake is not None, "half_width": row["half_width"]})
            yield pa.RecordBatch.from_pylist(made, schema=_schema(kind))

    met = None
    for rank in range(top, -1, -1):
        own = shaped_lines.where(F.col("rank") == rank)
        if met is None:
            joined = own.withColumn("join", F.lit(None).cast("double")).withColumn("join_flooded", F.lit(False)).withColumn("other_half", F.lit(0.0))
        else:
            heads = met.select(F.col("seg_id").alias("downstream"), F.col("first").alias("join"), F.col("flooded").alias("join_flooded"), F.col("half_width").alias("other_half"))
            joined = own.join(heads, "downstream", "left").withColumn("join_flooded", F.coalesce("join_flooded", F.lit(False))).withColumn("other_half", F.coalesce("other_half", F.lit(0.0)))
        part = written(joined.mapInArrow(up, kind), "joined")
        met = part if met is None else met.unionByName(part)

    last = "seg_id long, surface array<double>, bed array<double>, barriers array<array<int>>"

    def finish(batches):
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                a = _line(row)
                surface, raw = np.array(row["surface"]), a["level"]
                if not row["flooded"] and not row["spans"]:
                    surface = tilted(surface, raw, a["ceiling"], a["trench"], a["open"], row["carve"], rules)
                surface = softened(surface, raw, a["ceiling"], a["trench"], a["arc"], a["open"], row["carve"], spacing_m, rules)
                made.append({"seg_id": row["seg_id"], "surface": surface.tolist(), "bed": (surface - row["carve"]).tolist(), "barriers": row["barriers"]})
            yield pa.RecordBatch.from_pylist(made, schema=_schema(last))

    whole = shaped_lines.drop("surface", "downstream", "half_width").join(met.select("seg_id", "surface", "flooded"), "seg_id")
    return written(whole, "met").mapInArrow(finish, last)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<array<int>>": pa.list_(pa.list_(pa.int32()))}
    return pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in ddl.split(", ")])


def tie_branches(lines: DataFrame, branches: DataFrame) -> DataFrame:
    """``seg_id, surface`` of side channels: from the level of their river at the split down to where they end. Lines: ``seg_id, x, y``; branches: ``seg_id, start, end, upto`` (null: the last vertex)."""

    def run(batches):
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                x, y = np.array(row["x"]), np.array(row["y"])
                arc = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])
                made.append({"seg_id": row["seg_id"], "surface": tied(arc, row["start"], row["end"], len(x) - 1 if row["upto"] is None else row["upto"]).tolist()})
            yield pa.RecordBatch.from_pylist(made, schema=_schema("seg_id long, surface array<double>"))

    known = branches.where("start is not null and end is not null")
    return lines.select("seg_id", "x", "y").join(known, "seg_id").mapInArrow(run, "seg_id long, surface array<double>")


# --------------------------------------------------------------------------- the bed


def river_bed(cells: DataFrame, vertices: DataFrame, spacing_m: float, radius: int, *, most_m: float = 49.0) -> DataFrame:
    """``row, col, level, target``: the profiles spread over the rivers' samples: the level of the nearest vertex within half the channel's width and a cell, and the bed to be cut where it isn't deep enough.

    Cells: ``row, col, h, kind, half_width, depth, level`` (the water as it was); vertices: ``row, col, surface, bed``. Of vertices on one sample the lowest
    counts. The bed is never more than ``most_m`` below the highest ground of two samples around. ``radius`` bounds half widths in samples.
    """
    river = cells.where("kind = 1")
    source = vertices.groupBy("row", "col").agg(F.min("surface").alias("surface"), F.min("bed").alias("bed")).join(river.select("row", "col"), ["row", "col"], "left_semi")
    steps = [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]
    way = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(r * r + c * c).alias("d2")) for r, c in steps)))
    # Only sources send, each to the cells of a disc; the nearest wins, by distance, then by its own place.
    sent = source.withColumn("w", way).select((F.col("row") + F.col("w.r")).alias("row"), (F.col("col") + F.col("w.c")).alias("col"), F.struct("w.d2", F.col("row").alias("sr"), F.col("col").alias("sc"), "surface", "bed").alias("s"))
    near = sent.groupBy("row", "col").agg(F.min("s").alias("s"))
    wide = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(-2, 3) for c in range(-2, 3))))
    high = cells.withColumn("w", wide).select((F.col("row") + F.col("w.r")).alias("row"), (F.col("col") + F.col("w.c")).alias("col"), "h").groupBy("row", "col").agg(F.max("h").alias("high"))
    rows = river.join(near, ["row", "col"]).where(F.sqrt(F.col("s.d2")) * spacing_m <= F.col("half_width") + spacing_m).join(high, ["row", "col"])
    bed = F.greatest(F.col("s.bed"), F.col("high") - most_m)
    return rows.select("row", "col", F.col("s.surface").alias("level"), F.when(F.col("level") - F.col("depth") > bed, bed).alias("target"))


def burned_paths(path: DataFrame, segments: DataFrame) -> DataFrame:
    """``row, col, bed``: samples lowered to the running minimum of the bed along the lines' paths, which goes on from line to line downstream.

    Path: ``seg_id, place, row, col, bed, mark`` (0 open, 1 in a lake or on a flank: carried, not lowered; 2 a crest: begins anew); segments: ``seg_id, downstream``.
    The lowest end that flows in is what a line goes on from. What a line passes on is its running minimum's end, or from the last crest on; so a line
    is a step of a recurrence, min(what came in, own) or own alone, and ranks of lines take one round each.
    """
    path = written(path.where("bed is not null"), "path")
    along = Window.partitionBy("seg_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = path.withColumn("part", F.sum((F.col("mark") == 2).cast("int")).over(along))
    within = Window.partitionBy("seg_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = written(rows.withColumn("run", F.min("bed").over(within)), "runs")
    ends = rows.groupBy("seg_id").agg(F.max_by("run", "place").alias("end"), F.max("part").alias("parts"))
    ranked = written(link_ranks(segments).join(ends, "seg_id", "left").select("seg_id", "downstream", "rank", "end", F.coalesce("parts", F.lit(0)).alias("parts")), "ranked")
    top = ranked.agg(F.max("rank")).first()[0]
    ranks = [r["rank"] for r in ranked.select("rank").distinct().orderBy("rank").toLocalIterator()] if top is not None else []
    known = None
    for rank in ranks:
        own = ranked.where(F.col("rank") == rank)
        if known is None:
            fed = own.withColumn("came", F.lit(None).cast("double"))
        else:
            came = known.where("downstream is not null").groupBy(F.col("downstream").alias("seg_id")).agg(F.min("out").alias("came"))
            fed = own.join(came, "seg_id", "left")
        out = F.when(F.col("parts") > 0, F.col("end")).otherwise(F.least("end", "came"))
        part = written(fed.select("seg_id", "downstream", "came", out.cast("double").alias("out")), "passed")
        known = part if known is None else known.unionByName(part)
    if known is None:
        return path.select("row", "col", F.col("bed").cast("double").alias("bed")).limit(0)
    carried = rows.join(known.select("seg_id", "came"), "seg_id")
    low = F.when(F.col("part") == 0, F.least("run", "came")).otherwise(F.col("run"))
    return carried.where("mark = 0").groupBy("row", "col").agg(F.min(low).cast("double").alias("bed"))


def lines_of(vertices: DataFrame, segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Lines as ``profiles`` takes them, from vertices (``seg_id, ord, x, y, level, ceiling, trench``), segments (``seg_id, downstream, rank, half_width, carve``) and lake spans (``seg_id, a, b, level``)."""
    names = ("x", "y", "level", "ceiling", "trench")
    made = vertices.groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct("ord", *names))).alias("v"))
    arrays = made.select("seg_id", *map(_column, names))
    lakes = spans.groupBy("seg_id").agg(F.array_sort(F.collect_list(F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.col("level").cast("double").alias("level")))).alias("spans"))
    none = F.expr("cast(array() as array<struct<a:int,b:int,level:double>>)")
    return segments.join(arrays, "seg_id").join(lakes, "seg_id", "left").withColumn("spans", F.coalesce("spans", none))


def _column(name: str) -> Column:
    return F.transform("v", lambda v: v[name].cast("double")).alias(name)


def lowered_report(lines: DataFrame, shaped_lines: DataFrame) -> DataFrame:
    """One row: ``vertices, lowered`` (by how many the profile lies below the ground)``, median_m, most_m``."""
    drop = lines.select("seg_id", F.posexplode("level").alias("ord", "level")).join(shaped_lines.select("seg_id", F.posexplode("surface").alias("ord", "surface")), ["seg_id", "ord"]).select(F.greatest(F.col("level") - F.col("surface"), F.lit(0.0)).alias("d"))
    return drop.agg(F.count(F.lit(1)).alias("vertices"), F.count_if(F.col("d") > 0).alias("lowered"), F.coalesce(F.median(F.when(F.col("d") > 0, F.col("d"))), F.lit(0.0)).alias("median_m"), F.coalesce(F.max("d"), F.lit(0.0)).alias("most_m"))
