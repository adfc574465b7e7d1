"""Near-duplicates by ProbMinHash: registers filled by Poisson arrivals of shingles, then banding and verification.

A shingle of weight w arrives at times that are exponential gaps over w, each arrival at a register that its own random bits
name; a register keeps its first arrival. The arrivals of a shingle stop as soon as they come later than what every register
holds. Two texts agree in a register with the probability Jaccard similarity of their weights. Every distinct shingle weighs 1
however often it occurs, so that this is the plain Jaccard similarity of the two sets of shingles, which links are defined by.
Texts that agree in all registers of a band are candidates, and a candidate pair is a link when that similarity reaches the threshold.

Texts of the same words are one node. ``verify`` compares the members of buckets, and loses no link between candidates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tarn.llm import shingles
from tarn.llm.common import small_batches, texts, written
from tarn.llm.verify import bucket_components

#: Bands and registers in each. At a similarity of 0.8 a pair is missed with a probability of 3 in 100 000, at 0.9 of 1 in 10**9.
BANDS, ROWS = 20, 4


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def signature(elements: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """The element that arrives first at each register; ``elements`` are distinct 64-bit hashes, one at least."""
    first = np.full(registers, np.inf)
    held = np.zeros(registers, np.uint64)
    time = np.zeros(len(elements))
    seed, live, weight = 0, elements, weights
    while len(live):
        block = max(1, min(256, 2 * registers // len(live)))
        with np.errstate(over="ignore"):
            bits = shingles.mixed(live[:, None] + (np.arange(seed + 1, seed + 1 + block, dtype=np.uint64) * shingles.MULTIPLIER)[None, :])
            where = (shingles.mixed(bits + shingles.MULTIPLIER) % np.uint64(registers)).astype(np.int64)
        times = time[:, None] + np.cumsum(-np.log(_uniform(bits)), 1) / weight[:, None]
        np.minimum.at(first, where.ravel(), times.ravel())
        own, register = np.nonzero(times == first[where])
        held[where[own, register]] = live[own]
        seed += block
        time = times[:, -1]
        on = time < first.max()
        live, weight, time = live[on], weight[on], time[on]
    return held


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, node`` (128-bit hash of the words) and ``keys``, a hash for each band; none for a text without words."""

    def run(batches):
        for batch in small_batches(batches, shingles.TOGETHER):
            words, edges = shingles.word_hashes(batch.column(1).to_pylist())
            nodes, keys = [], []
            for a, b in zip(edges, edges[1:], strict=False):
                own = words[a:b]
                nodes.append(hashlib.blake2b(own, digest_size=16).digest())
                if a == b:
                    keys.append([])
                    continue
                elements = np.unique(shingles.shingle_hashes(own, size))
                held = signature(elements, np.ones(len(elements)), BANDS * ROWS).reshape(BANDS, ROWS)
                with np.errstate(over="ignore"):
                    key = np.arange(BANDS, dtype=np.uint64)
                    for k in range(ROWS):
                        key = shingles.mixed(key * shingles.MULTIPLIER + held[:, k])
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "keys"])

    return texts(docs).mapInArrow(run, "doc_id long, node binary, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``node, items`` (sorted distinct 32-bit shingle hashes) of the nodes in ``wanted`` (``node, doc_id``), and perhaps of more.

    A node is found by its ``doc_id``; of an id that several texts have, all are hashed. Rows without one have no other key, so
    all of them are hashed.
    """

    def run(batches):
        for batch in small_batches(batches, shingles.TOGETHER):
            words, edges = shingles.word_hashes(batch.column(0).to_pylist())
            nodes, items = [], []
            for a, b in zip(edges, edges[1:], strict=False):
                own = words[a:b]
                nodes.append(hashlib.blake2b(own, digest_size=16).digest())
                items.append(np.unique(shingles.shingle_hashes(own, size).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(items, pa.list_(pa.int32()))], ["node", "items"])

    named = texts(docs).join(wanted.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    bare = texts(docs).where("doc_id is null").select("text")
    some = named if wanted.where("doc_id is null").isEmpty() else named.union(bare)
    return some.mapInArrow(run, "node binary, items array<int>").dropDuplicates(["node"])


def _with_node(rows: DataFrame) -> DataFrame:
    """``rows`` (``row, doc_id, text``) with ``node``, the hash of a row's words, and without the text."""

    def run(batches):
        for batch in small_batches(batches, shingles.TOGETHER):
            words, edges = shingles.word_hashes([t or "" for t in batch.column(2).to_pylist()])
            nodes = [hashlib.blake2b(words[a:b], digest_size=16).digest() for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary())], ["row", "doc_id", "node"])

    return rows.mapInArrow(run, StructType([rows.schema["row"], rows.schema["doc_id"], StructField("node", BinaryType())]))


def _grouped(docs: DataFrame, shingle: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as ``doc_id, node``, and for each node ``node, comp, doc_id`` (its smallest, if any) and ``rows``."""
    base = written(_signed(docs, shingle), "signed")
    nodes = written(base.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("rows")), "nodes")
    banded = nodes.select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = written(banded.join(shared, "key"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    sets = written(_sets(docs, wanted, shingle), "sets")
    comps = bucket_components(members, sets, threshold)
    return base.select("doc_id", "node"), nodes.select("node", "doc_id", "rows").join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "doc_id", "rows")


def near_groups(docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, class_id, class_size``, and ``node``, the hash of its words.

    ``class_id`` is the smallest ``doc_id`` of all texts that links join, ``class_size`` their rows. A null text is an empty one;
    texts without words are one class, and texts under ``shingle`` words have one shingle. A row without ``doc_id`` is in the
    class of its text like any other; a class of such rows alone has no ``class_id``. Repeated rows are copies. Other columns
    of ``docs`` are not used. An empty table gives none.
    """
    base, of = _grouped(docs, shingle, threshold)
    classes = of.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.sum("rows").alias("class_size"))
    named = of.select("node", "comp").join(classes, "comp").select("node", "class_id", "class_size")
    return base.join(named, "node").select("doc_id", "class_id", "class_size", "node")


def drop_near_copies(docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each class, with all its columns: one of the smallest ``doc_id``, of repeated rows any.

    Rows without a ``doc_id`` stay only where all rows of their class lack one, and then one does. Rows of one ``doc_id`` with different
    texts are told apart by their words.
    """
    base, of = _grouped(docs, shingle, threshold)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    place = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "node")
    if base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        # One row for each id, so an id is enough. Those that go are fewer than those that stay: only they are sent to the rows.
        first = of.groupBy("comp").agg(F.min(place).alias("s"), F.count(F.lit(1)).alias("nodes"), F.sum("rows").alias("rows")).where("rows > 1")
        lose = base.join(of.select("node", "comp"), "node").join(first, "comp").where(~F.col("doc_id").eqNullSafe(F.col("s.doc_id")))
        lost = written(lose.select("doc_id"), "lost")
        bare = not lost.where("doc_id is null").isEmpty()
        kept = rows.join(lost.where("doc_id is not null"), "doc_id", "left_anti")
        return (kept.where("doc_id is not null") if bare else kept).select("row.*")
    first = of.groupBy("comp").agg(F.min(place).alias("s"))
    stay = written(first.select(F.col("s.doc_id").alias("doc_id"), F.col("s.node").alias("node")), "stay")
    keep = stay.select(F.col("doc_id").alias("id"), "node")
    own = (F.col("r.node") == F.col("k.node")) & F.col("r.doc_id").eqNullSafe(F.col("k.id"))
    found = _with_node(rows).alias("r").join(keep.alias("k"), own, "left_semi")
    return found.groupBy("node").agg(F.first("row").alias("row")).select("row.*")
