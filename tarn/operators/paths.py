"""Operators along single lines that are sequential by nature: each line is one group of a bounded size, in a NumPy kernel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def cheapest_offsets(cost: np.ndarray, reach: np.ndarray, turn: float, step: float) -> np.ndarray | None:
    """The cheapest way through (vertex, offset): ``cost`` of each (infinite: barred), offsets may change by ``reach[i]`` places into vertex i, each metre of
    change costing ``turn``; of equals the first offset. None if there is no way."""
    n, many = cost.shape
    total, back = cost[0].astype(float), np.zeros((n, many), int)
    places = np.arange(many)
    apart = np.abs(places[:, None] - places[None, :])
    for i in range(1, n):
        way = np.where(apart <= reach[i], total[None, :] + turn * step * apart, np.inf)
        back[i] = way.argmin(1)
        total = way[places, back[i]] + np.where(np.isfinite(cost[i]), cost[i], np.inf)
    if not np.isfinite(total).any():
        return None
    out = np.empty(n, int)
    out[-1] = total.argmin()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def snap_lines(cuts: DataFrame, *, step_m: float = 1.0, turn_cost: float = 0.05, drift: float = 0.6) -> DataFrame:
    """``seg_id, ord, offset``: how far each vertex moves to its side so that the line follows the bottom of its valley.

    ``cuts``: ``seg_id, ord, along`` (metres from the vertex before)``, costs`` (of each offset, centred; null: barred). A line with no way stays.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        cost = np.array([[np.inf if v is None or np.isnan(v) else v for v in c] for c in pdf["costs"]], float)
        reach = np.maximum(1, np.floor(pdf["along"].fillna(0).to_numpy() * drift / step_m)).astype(int)
        best = cheapest_offsets(cost, reach, turn_cost, step_m)
        middle = cost.shape[1] // 2
        offset = np.zeros(len(pdf)) if best is None else (best - middle) * step_m
        return pd.DataFrame({"seg_id": pdf["seg_id"], "ord": pdf["ord"], "offset": offset})

    return cuts.groupBy("seg_id").applyInPandas(run, "seg_id long, ord int, offset double")


def grade_tails(lines: DataFrame, *, grade: float = 0.30, taper: int = 4, touch_m: float = 0.0) -> DataFrame:
    """``seg_id, ord, surface``: the end of each line lowered to meet ``junction`` at no more than ``grade``, by no more than ``most``.

    ``lines``: ``seg_id, ord, surface, along`` (metres to the next vertex)``, junction, most``. Going up from the junction the grade is followed until it would
    lower the line too far; from there what is lowered runs out over ``taper`` vertices. Lines without a junction stay.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        z = pdf["surface"].to_numpy(float)
        level, most = pdf["junction"].iloc[0], max(float(pdf["most"].iloc[0]), 0.0)
        if pd.notna(level):
            to_end = np.append(np.cumsum(pdf["along"].to_numpy(float)[:-1][::-1])[::-1], 0.0)
            bound = level + grade * np.maximum(to_end - touch_m, 0)
            beyond = np.flatnonzero(np.maximum(z - bound, 0) > most + 1e-9)
            if len(beyond):
                stop = beyond[-1]
                allowed = np.interp(np.arange(len(z)), [stop - taper, stop], [0.0, most]) if taper else np.where(np.arange(len(z)) < stop, 0.0, most)
                if taper and stop < taper:
                    allowed = np.interp(np.arange(len(z)), [0, stop], [0.0, most]) if stop else np.full(len(z), most)
                bound = np.maximum(bound, z - allowed)
            z = np.minimum(z, bound)
        return pd.DataFrame({"seg_id": pdf["seg_id"], "ord": pdf["ord"], "surface": z})

    return lines.groupBy("seg_id").applyInPandas(run, "seg_id long, ord int, surface double")
