"""Best-fit packing by patterns: non-negative least squares fits how often each few-document pattern of lengths is used.

The plan is made from the histogram of lengths alone, which has at most ``capacity`` bins whatever the size of the corpus:

1. Patterns are all pairs and triples of lengths that fill a sequence exactly, as far as the histogram has their lengths
   (the third lengths of triples on a grid, so that their number stays bounded).
2. Projected accelerated gradient descent fits non-negative repeat counts so that the patterns' lengths sum to the histogram.
3. The counts are rounded, never beyond what the histogram still has.
4. What remains is packed best-fit, longest first, on the histogram.

Then every piece takes its place by its rank among the pieces of its length, with no gathering of pieces in one task.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm import tokens
from tarn.llm.common import small_batches, texts, written

#: Patterns fitted at most: the grid of third lengths gets coarser until they are so few.
MAX_PATTERNS = 60_000
#: Steps of the descent.
STEPS = 400
#: Pieces of one length and salt that are ranked together, on average at most.
RANKED_TOGETHER = 100_000


def piece_lengths(n: int, capacity: int) -> list[int]:
    """How a document of ``n`` ids is cut: whole if it fits, else into pieces of ``capacity``, the first perhaps shorter."""
    if n <= capacity:
        return [n] if n else []
    short = n % capacity
    return [short] * bool(short) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, *, vocabulary: str, capacity: int = 2048, end_id: int | None = 0, words: int | None = None) -> DataFrame:
    """Encode every whole text (null: empty), append ``end_id``, and cut only what is longer than ``capacity``.

    ``doc_id, piece, start, length, ids`` (u16 little-endian)``, ids_crc32`` (of the ids as u32). Without an ``end_id`` an
    empty text gives no piece. Repeated rows are packed as often as they occur. Other columns of ``docs`` are not used. ``words`` bounds the
    words that a worker remembers, and so its memory; see ``tokens``.
    """
    tail = b"" if end_id is None else end_id.to_bytes(2, "little")
    names, kinds = ["doc_id", "piece", "start", "length", "ids", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def cut(batches):
        encoder = tokens.library_encoder(vocabulary, words)
        for batch in small_batches(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, start = encoder.encode(text) + tail, 0
                for piece, length in enumerate(piece_lengths(len(ids) // 2, capacity)):
                    own = ids[2 * start : 2 * (start + length)]
                    rows.append((doc_id, piece, start, length, own, zlib.crc32(np.frombuffer(own, "<u2").astype("<u4"))))
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

    return texts(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long")


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths, 0 for none, that fill ``capacity`` exactly with lengths of ``present``; longest first."""
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    a = np.arange((capacity + 1) // 2, capacity)
    pairs = a[have[a] & have[capacity - a]]
    found = [np.stack([pairs, capacity - pairs, 0 * pairs], 1)]
    grid = 1
    while True:
        c = np.arange(grid, capacity // 3 + 1, grid)
        b = np.arange(1, capacity // 2 + 1)
        bb, cc = np.meshgrid(b, c[have[c]], indexing="ij")
        aa = capacity - bb - cc
        ok = (bb >= cc) & (aa >= bb) & have[bb] & have[np.clip(aa, 0, capacity)]
        if ok.sum() <= MAX_PATTERNS or grid > capacity:
            found.append(np.stack([aa[ok], bb[ok], cc[ok]], 1))
            return np.concatenate(found)
        grid *= 2


def fitted(rows: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeats x of the patterns that least miss the histogram: min ||A x - h||, by accelerated projected gradient."""
    size = len(histogram)
    if not len(rows):
        return np.zeros(0)
    flat = rows.ravel()

    def forward(x):
        out = np.bincount(flat, np.repeat(x, 3), size)
        out[0] = 0
        return out

    def back(r):
        return r[rows].sum(1)

    h = histogram.astype(float)
    h[0] = 0
    v = np.ones(len(rows))
    for _ in range(30):  # the largest eigenvalue of A'A
        v = back(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (np.linalg.norm(back(forward(v))) * 1.02)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - step * back(forward(y) - h), 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


@dataclass
class Plan:
    """Slots: of the pieces of ``length``, those with ranks from ``first`` on go to sequences ``base``, ``base + 1``, ... at ``offset``; sorted by length and first."""

    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(histogram: np.ndarray, capacity: int) -> Plan:
    """Pack a histogram of lengths (index: length, up to ``capacity``) into sequences; its size doesn't depend on the counts."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    taken = np.zeros_like(left)
    slots: list[tuple[int, int, int, int]] = []
    sequences = 0

    def place(lengths, repeats: int) -> None:
        nonlocal sequences
        offset = 0
        for n in lengths:
            slots.append((n, int(taken[n]), sequences, offset))
            taken[n] += repeats
            left[n] -= repeats
            offset += n
        sequences += repeats

    if left[capacity]:
        place([capacity], int(left[capacity]))
    rows = patterns(np.flatnonzero(left), capacity)
    repeats = fitted(rows, left)
    for k in np.argsort(-repeats, kind="stable"):
        want = round(repeats[k])
        if want < 1:
            break
        lengths = [int(n) for n in rows[k] if n]
        fits = min(int(left[n]) // lengths.count(n) for n in lengths)
        if fits:
            place(lengths, min(want, fits))
    # Best fit on what remains: open holds, by free room, how many sequences have it and which lengths are in them.
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in range(capacity - 1, 0, -1):
        while left[n]:
            room = min((r for r in open_ if r >= n), default=None)
            if room is None:
                each = capacity // n
                many, rest = divmod(int(left[n]), each)
                if many:
                    open_.setdefault(capacity - each * n, []).append(((n,) * each, many))
                if rest:
                    open_.setdefault(capacity - rest * n, []).append(((n,) * rest, 1))
                left[n] = 0
            else:
                lengths, many = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                now = min(many, int(left[n]))
                if many > now:
                    open_.setdefault(room, []).append((lengths, many - now))
                open_.setdefault(room - n, []).append(((*lengths, n), now))
                left[n] -= now
    for room in sorted(open_):
        for lengths, many in open_[room]:
            place(lengths, many)
    order = sorted(slots)
    columns = np.array(order, np.int64).reshape(-1, 4).T
    return Plan(*columns, sequences)


def pack(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``; ``doc_id`` and ``piece`` order those of one length.

    ``pieces`` is read three times, so give a written table. All its columns stay. Pieces of no length or a null one have no
    place and are left out; longer ones raise. The driver gets the histogram only (``capacity`` rows at most). The rank of a piece
    comes from its rank among its length and salt, with as many salts as the table needs, so a length that a third of
    all pieces have is ranked by many tasks. Its slot comes from a broadcast of the plan, whose size ``slot_bins`` bounds.
    """
    counts = {r["length"]: r["n"] for r in pieces.where("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(n > capacity for n in counts):
        raise ValueError(f"a piece is longer than {capacity}")
    histogram = np.zeros(capacity + 1, np.int64)
    for n, many in counts.items():
        histogram[n] = many
    made = plan(histogram, capacity)
    salts = max(16, int(histogram.sum()) // RANKED_TOGETHER)
    spark = pieces.sparkSession
    wide, slots = slot_bins(made, histogram)
    widths = F.broadcast(spark.createDataFrame([(int(n), int(wide[n])) for n in np.flatnonzero(histogram)] or [(0, 1)], "length long, __wide long"))
    salted = pieces.where("length > 0").withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n")).select("length", "__salt", before.alias("__before")).join(widths, "length")
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(offsets, ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before")).withColumn("__bin", F.floor(F.col("__rank") / F.col("__wide")))
    table = F.broadcast(spark.createDataFrame(slots, "length long, __bin long, __first long, __end long, __base long, offset long"))
    within = (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__end"))
    here = [F.col(f"r.{c}") for c in pieces.columns]
    out = ranked.alias("r").join(table.alias("t"), (F.col("r.length") == F.col("t.length")) & (F.col("r.__bin") == F.col("t.__bin")) & within)
    return out.select(*here, (F.col("__base") + F.col("__rank") - F.col("__first")).alias("sequence_id"), F.col("t.offset"))


def slot_bins(made: Plan, histogram: np.ndarray) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Bins of ranks for each length, so that a piece finds its slot by an equi-join: the width of a length's bins, and a row
    ``(length, bin, first, end, base, offset)`` for each slot and each bin that it touches.

    A length of s slots has at most s bins, so there are fewer than two rows for each slot, and the slots are as many as the
    plan has (``MAX_PATTERNS`` patterns of three lengths, and the residual's): the size doesn't depend on the corpus.
    """
    many = np.bincount(made.length, minlength=len(histogram)) if len(made.length) else np.zeros(len(histogram), np.int64)
    wide = np.maximum(1, -(-histogram // np.maximum(1, many)))
    end = np.append(made.first[1:], 0)
    last = np.append(made.length[1:] != made.length[:-1], True) if len(made.length) else np.zeros(0, bool)
    end = np.where(last, histogram[made.length], end)[: len(made.length)]
    rows = []
    for n, a, b, base, offset in zip(made.length.tolist(), made.first.tolist(), end.tolist(), made.base.tolist(), made.offset.tolist(), strict=True):
        w = int(wide[n])
        rows += [(n, k, a, b, base, offset) for k in range(a // w, (b - 1) // w + 1)]
    return wide, rows


def packed_documents(docs: DataFrame, *, vocabulary: str, capacity: int = 2048, end_id: int | None = 0, words: int | None = None) -> DataFrame:
    """``token_pieces`` of ``docs``, written once, with their places: ``doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset``."""
    return pack(written(token_pieces(docs, vocabulary=vocabulary, capacity=capacity, end_id=end_id, words=words), "pieces"), capacity=capacity)
