"""The fixed binary products: atlases of tiles, tables of records, and the height codec. All numbers are little-endian.

Tables are drained in order, a partition at a time, into one file, so the driver holds no table. Magic strings and layouts are fixed values
of the formats.
"""

from __future__ import annotations

import gzip
import os
import struct
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.plans.lattice import GridPlan

NONE = 0xFFFFFFFF
NODATA = -(1 << 31)

#: Records: magic, header fields after the magic, record fields. Fixed values.
NODE = np.dtype(
    [(n, "<u4") for n in ("parent", "overflow_to", "floor_cell", "spill_cell", "outlet_cell", "cell_count", "subtree_cells")]
    + [("floor_code", "<u2"), ("spill_code", "<u2"), ("floor_m", "<f4"), ("spill_m", "<f4"), ("authored_level_m", "<f4"), ("lake_id", "<u2"), ("flags", "<u2"), ("outflow_head_m", "<f4")]
)
CURVE = np.dtype([("max_code", "<u2"), ("flags", "<u2"), ("area", "<f4", (64,))])
SAMPLE = np.dtype([("label", "<u4"), ("lake_id", "<i4"), ("count", "<u4")])
BRANCH = struct.Struct("<IIIfiIHH")
MAGIC = {"hierarchy": b"KVDEPH01", "hypsometry": b"KVHYPS01", "catchments": b"KVCTCH01", "rivers": b"KVRIVER2", "widths": b"KVRWIDT1", "branches": b"KVRBRAN1"}
HEADERS = {"hierarchy": struct.Struct("<8sIIIIIIII"), "hypsometry": struct.Struct("<8sIIIIII"), "catchments": struct.Struct("<8sIIII")}


def ordered(df: DataFrame, *keys: str) -> Iterable:
    """Rows in order, one partition at a time on the driver."""
    return df.orderBy(*keys).toLocalIterator(prefetchPartitions=True)


def write_table(path: str, kind: str, header: tuple, dtype: np.dtype, rows: Iterable[tuple]) -> int:
    """A header and one record for each row; the bytes written."""
    size = 0
    with open(path, "wb") as f:
        size += f.write(HEADERS[kind].pack(MAGIC[kind], *header))
        block: list[tuple] = []
        for row in rows:
            block.append(row)
            if len(block) == 1 << 14:
                size += f.write(np.array(block, dtype).tobytes())
                block = []
        size += f.write(np.array(block, dtype).tobytes())
    return size


def read_table(path: str, kind: str, dtype: np.dtype, record_bytes: int | None = None) -> tuple[tuple, np.ndarray]:
    """Header fields and records. Records may be longer than ``dtype`` (``record_bytes``): what a newer writer adds is passed over."""
    with open(path, "rb") as f:
        data = f.read()
    head = HEADERS[kind]
    magic, *fields = head.unpack_from(data)
    if magic != MAGIC[kind]:
        raise ValueError(f"{path} is no {kind} file")
    size = record_bytes or dtype.itemsize
    body = np.frombuffer(data, np.uint8, offset=head.size)
    if size < dtype.itemsize or len(body) % size:
        raise ValueError(f"{path}: {len(body)} bytes are no whole number of records of {size}")
    return tuple(fields), np.ascontiguousarray(body.reshape(-1, size)[:, : dtype.itemsize]).view(dtype).ravel()


def write_cells(path: str, cells: DataFrame, column: str = "cell") -> int:
    """u32 count, then ascending u32 cells."""
    n = cells.count()
    with open(path, "wb") as f:
        f.write(struct.pack("<I", n))
        for row in ordered(cells.select(column), column):
            f.write(struct.pack("<I", row[0]))
    return n


def read_cells(path: str) -> np.ndarray:
    with open(path, "rb") as f:
        data = f.read()
    (n,) = struct.unpack_from("<I", data)
    cells = np.frombuffer(data, "<u4", offset=4)
    if len(cells) != n or (np.diff(cells.astype(np.int64)) <= 0).any():
        raise ValueError(f"{path}: cells are short or out of order")
    return cells


def write_lake_runs(path: str, runs: DataFrame) -> int:
    """u32 lakes; for each, by id: i32 id, u32 runs, then (u32 first cell, u32 length) by cell. ``runs``: ``lake_id, first_cell, length``."""
    counts = dict(runs.groupBy("lake_id").count().collect())
    with open(path, "wb") as f:
        f.write(struct.pack("<I", len(counts)))
        now = None
        for lake, first, length in ordered(runs.select("lake_id", "first_cell", "length"), "lake_id", "first_cell"):
            if lake != now:
                now = lake
                f.write(struct.pack("<iI", lake, counts[lake]))
            f.write(struct.pack("<II", first, length))
    return len(counts)


def read_lake_runs(path: str) -> dict[int, list[tuple[int, int]]]:
    with open(path, "rb") as f:
        data = f.read()
    (lakes,), at, out = struct.unpack_from("<I", data), 4, {}
    for _ in range(lakes):
        lake, n = struct.unpack_from("<iI", data, at)
        own = np.frombuffer(data, "<u4", 2 * n, at + 8).reshape(-1, 2)
        if (np.diff(own[:, 0].astype(np.int64)) <= 0).any() or (out and lake <= max(out)):
            raise ValueError(f"{path}: lake {lake} is out of order")
        out[lake] = [(int(a), int(b)) for a, b in own]
        at += 8 + 8 * n
    if at != len(data):
        raise ValueError(f"{path}: {len(data) - at} bytes too many")
    return out


def write_lake_samples(path: str, counts: DataFrame) -> int:
    """u32 count, then (label, lake, count) in that order. ``counts``: ``label, lake_id, n``."""
    rows = [tuple(r) for r in ordered(counts.select("label", "lake_id", "n"), "label", "lake_id")]
    with open(path, "wb") as f:
        f.write(struct.pack("<I", len(rows)) + np.array(rows, SAMPLE).tobytes())
    return len(rows)


def read_lake_samples(path: str) -> np.ndarray:
    with open(path, "rb") as f:
        data = f.read()
    (n,) = struct.unpack_from("<I", data)
    out = np.frombuffer(data, SAMPLE, offset=4)
    keys = list(zip(out["label"].tolist(), out["lake_id"].tolist(), strict=True))
    if len(out) != n or keys != sorted(set(keys)):
        raise ValueError(f"{path}: records are short or out of order")
    return out


def tiles(levels: DataFrame, plan: GridPlan, dtype: str, fill: float = 0) -> DataFrame:
    """``level, ty, tx, at, data``: each tile's bytes and its place in an atlas. ``levels``: ``level, row, col, value``; missing samples are ``fill``.

    Samples on a shared edge go to every tile that has them. A tile is one group, of a size that the plan bounds.
    """
    n, width = plan.tile_cells, np.dtype(dtype).itemsize
    bases = F.array(*(F.lit(b).cast("long") for b in plan.level_bases(width)))
    shape = [plan.level_samples(k) for k in range(plan.num_levels)]
    sizes = F.array(*(F.lit(y) for _, y in shape)), F.array(*(F.lit(plan.tiles_at(k)[0]) for k in range(plan.num_levels)))
    up = F.get(sizes[0], F.col("level")) - 1 - F.col("row")

    def owners(at, top: int | None = None):
        own = F.floor(at / n).cast("int")
        return F.filter(F.when(at % n == 0, F.array(own - 1, own)).otherwise(F.array(own)), lambda t: t >= 0)

    each = levels.withColumn("up", up).withColumn("ty", F.explode(owners(F.col("up")))).withColumn("tx", F.explode(owners(F.col("col"))))
    across, along = F.get(sizes[1], F.col("level")), F.floor((F.get(sizes[0], F.col("level")) - 1) / n)
    each = each.where((F.col("tx") < across) & (F.col("ty") < along))
    place = F.get(bases, F.col("level")) + (F.col("ty") * across + F.col("tx")).cast("long") * plan.tile_bytes(width)
    each = each.select("level", "ty", "tx", place.alias("at"), (F.lit(n) - (F.col("up") - F.col("ty") * n)).alias("r"), (F.col("col") - F.col("tx") * n).alias("c"), "value")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = np.full((n + 1, n + 1), fill, dtype)
        tile[pdf["r"], pdf["c"]] = pdf["value"]
        first = pdf.iloc[0]
        return pd.DataFrame({"level": [first["level"]], "ty": [first["ty"]], "tx": [first["tx"]], "at": [first["at"]], "data": [tile.tobytes()]})

    return each.groupBy("level", "ty", "tx").applyInPandas(build, "level int, ty int, tx int, at long, data binary")


def write_atlas(made: DataFrame, plan: GridPlan, bytes_per_sample: int, path: str) -> int:
    """One file of all tiles, each at its place; tiles that are missing stay zero."""
    total = plan.total_bytes(bytes_per_sample)
    with open(path, "wb") as f:
        f.truncate(total)
        for row in ordered(made.select("at", "data"), "at"):
            f.seek(row["at"])
            f.write(row["data"])
    return total


def read_level(path: str, plan: GridPlan, level: int, dtype: str) -> np.ndarray:
    """A level put together again from its tiles' places alone; a short file raises."""
    width = np.dtype(dtype).itemsize
    sx, sy = plan.level_samples(level)
    out = np.zeros((sy, sx), dtype)
    across, along = plan.tiles_at(level)
    with open(path, "rb") as f:
        for y in range(along):
            for x in range(across):
                f.seek(plan.tile_offset(level, x, y, width))
                data = f.read(plan.tile_bytes(width))
                if len(data) < plan.tile_bytes(width):
                    raise ValueError(f"{path} ends in tile {x}, {y} of level {level}")
                row, col, n = plan.tile_rows(level, x, y)
                out[row : row + n, col : col + n] = np.frombuffer(data, dtype).reshape(n, n)
    return out


def check_atlas(path: str, plan: GridPlan, bytes_per_sample: int) -> list[str]:
    """What is wrong with an atlas's size; nothing if it is right."""
    size, want = os.path.getsize(path), plan.total_bytes(bytes_per_sample)
    return [] if size == want else [f"{size} bytes, {want} expected"]


def write_heights(path: str, heights: np.ndarray, compression: str = "lossless") -> dict:
    """Heights (NaN: none) as they are, or rounded to millimetres or centimetres, in byte planes under gzip."""
    quantum = {"none": None, "lossless": None, "mm": 0.001, "cm": 0.01}[compression]
    data = heights.astype("<f4")
    if quantum:
        data = np.where(np.isfinite(heights), np.rint(np.nan_to_num(heights.astype(float)) / quantum), NODATA).astype("<i4")
    raw = data.tobytes()
    if compression != "none":
        raw = gzip.compress(np.frombuffer(raw, np.uint8).reshape(-1, 4).T.tobytes(), 6, mtime=0)
    with open(path, "wb") as f:
        f.write(raw)
    return {"compression": compression, "quantum_m": quantum, "bytes": len(raw)}


def read_heights(path: str, block: dict, shape: tuple[int, int]) -> np.ndarray:
    with open(path, "rb") as f:
        raw = f.read()
    if block["compression"] != "none":
        raw = np.frombuffer(gzip.decompress(raw), np.uint8).reshape(4, -1).T.tobytes()
    if not block["quantum_m"]:
        return np.frombuffer(raw, "<f4").reshape(shape)
    codes = np.frombuffer(raw, "<i4").reshape(shape)
    return np.where(codes == NODATA, np.nan, codes * block["quantum_m"]).astype("f4")


def write_branches(path: str, rows: Iterable[tuple]) -> int:
    """Side channels: count, then 28 bytes each."""
    packed = [BRANCH.pack(*r) for r in rows]
    with open(path, "wb") as f:
        f.write(struct.pack("<8sII", MAGIC["branches"], len(packed), BRANCH.size) + b"".join(packed))
    return len(packed)
