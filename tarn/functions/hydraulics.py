"""Widths and depths of channels from stream order and from discharge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full width and depth in metres for stream orders 1 to 8; fixed values.
WIDTH_BY_ORDER = (2.0, 3.0, 5.0, 8.0, 14.0, 25.0, 45.0, 80.0)
DEPTH_BY_ORDER = (1.5, 2.25, 3.0, 4.0, 5.5, 7.0, 9.0, 11.0)
#: Seconds of a year of 365.25 days.
YEAR_S = 31557600.0


def by_order(order: Column, values: tuple[float, ...], scale: float = 1.0) -> Column:
    """The value of an order, the first or last for orders beyond the table."""
    place = F.least(F.greatest(order, F.lit(1)), F.lit(len(values)))
    return F.element_at(F.array(*map(F.lit, values)), place.cast("int")) * scale


def width_from_discharge(q: Column, *, coefficient: float = 8.0, exponent: float = 0.5, low: float = 2.0, high: float = 80.0, scale: float = 1.0) -> Column:
    return F.least(F.greatest(F.pow(F.greatest(q, F.lit(0.0)), F.lit(exponent)) * coefficient, F.lit(low)), F.lit(high)) * scale


def depth_from_discharge(q: Column, *, coefficient: float = 2.0, exponent: float = 0.3, low: float = 0.5, high: float = 5.0) -> Column:
    return F.least(F.greatest(F.pow(F.greatest(q, F.lit(0.0)), F.lit(exponent)) * coefficient, F.lit(low)), F.lit(high))


def segment_depth(depth: Column, order: Column, scale: float = 1.0) -> Column:
    """A segment's own depth where it is finite and positive, else by its order."""
    return F.when((depth > 0) & (depth < float("inf")), depth).otherwise(by_order(order, DEPTH_BY_ORDER, scale))


def channel_half_width(order: Column, spacing_m: float, width: Column | None = None, scale: float = 1.0) -> Column:
    """Half the channel's width, half a cell at least; half a cell where there is no order."""
    full = by_order(order, WIDTH_BY_ORDER, scale)
    full = full if width is None else F.coalesce(F.when(width > 0, width), full)
    return F.when(order > 0, F.greatest(full / 2, F.lit(spacing_m / 2))).otherwise(spacing_m / 2)


def smoothstep(t: Column) -> Column:
    x = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return x * x * (F.lit(3.0) - F.lit(2.0) * x)


def shore_profile(q: Column, k: float = 0.9, b: float = 0.6) -> Column:
    """Depth share of a lake bed at a share q of the way from the shore: b (1 - exp(-k q / b))."""
    return (F.lit(1.0) - F.exp(-q * k / b)) * b
