"""How heights, water surfaces and water classes are packed into unsigned integers, and how cells and tiles are addressed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of a water raster; fixed values. A lake's code is LAKE_BASE plus its number.
DRY, RIVER, OCEAN, LAKE_BASE = 0, 1, 2, 16
NO_SURFACE = 65535
#: Types of water samples, and classes as decoded; fixed values.
LAND, RIVER_TYPE, LAKE_TYPE = 0, 1, 2
CLASS_DRY, CLASS_LAKE, CLASS_RIVER, CLASS_OCEAN = 0, 1, 2, 3


def _scaled(value: Column, low: Column, high: Column, top: int) -> Column:
    """Half-even rounding of the clamped share of the range; null stays null."""
    share = (value.cast("double") - low) / F.greatest(high - low, F.lit(1e-6))
    return F.when(value.isNotNull(), F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * top).cast("int"))


def pack_height(value: Column, low: Column, high: Column) -> Column:
    """16-bit code of a height in the range; null for a null."""
    return _scaled(value, low, high, 65535)


def unpack_height(code: Column, low: Column, high: Column) -> Column:
    return low + code / F.lit(65535.0) * (high - low)


def height_to_code(metres: Column, low: Column, high: Column) -> Column:
    """The fractional code of a height, as it stands before rounding."""
    return (metres.cast("double") - low) / F.greatest(high - low, F.lit(1e-6)) * 65535


def pack_surface(value: Column, low: Column, high: Column) -> Column:
    """16-bit code of a water surface, ``NO_SURFACE`` for none."""
    return F.coalesce(_scaled(value, low, high, 65534), F.lit(NO_SURFACE))


def unpack_surface(code: Column, low: Column, high: Column) -> Column:
    return F.when(code != NO_SURFACE, low + code / F.lit(65534.0) * (high - low))


def water_code(kind: Column, lake_id: Column, ocean: Column) -> Column:
    """The code of a sample: lake over river over ocean over dry."""
    return F.when(kind == LAKE_TYPE, lake_id + LAKE_BASE).when(kind == RIVER_TYPE, RIVER).when(ocean, OCEAN).otherwise(DRY)


def water_class(code: Column) -> Column:
    return F.when(code >= LAKE_BASE, CLASS_LAKE).when(code == RIVER, CLASS_RIVER).when(code == OCEAN, CLASS_OCEAN).otherwise(CLASS_DRY)


def water_lake_id(code: Column) -> Column:
    return F.when(code >= LAKE_BASE, code - LAKE_BASE).otherwise(0)


def tiles_along(leaf_tiles: Column, level: Column) -> Column:
    """Tiles along an axis at a level."""
    return F.greatest(F.lit(1), F.expr("1") * F.floor(leaf_tiles / F.pow(F.lit(2.0), level)).cast("int"))


def cell_of(row: Column, col: Column, samples_x: int) -> Column:
    return row.cast("long") * samples_x + col


def world_to_grid(x: Column, y: Column, plan) -> tuple[Column, Column]:
    """Fractional row and column of a point; row 0 is the northern edge."""
    return (plan.samples_y - 1) - (y - plan.origin_y) / plan.spacing_m, (x - plan.origin_x) / plan.spacing_m


def cell_xy(row: Column, col: Column, samples_y: int, origin_x: float, origin_y: float, spacing_m: float) -> tuple[Column, Column]:
    """Where a sample lies; row 0 is the northern edge."""
    return F.lit(origin_x) + col * spacing_m, F.lit(origin_y) + (F.lit(samples_y - 1) - row) * spacing_m


def nearest_index(at: Column, samples: int) -> Column:
    """The sample nearest to a fractional index: half-even, clamped to the lattice."""
    return F.least(F.greatest(F.rint(at), F.lit(0)), F.lit(samples - 1)).cast("int")
