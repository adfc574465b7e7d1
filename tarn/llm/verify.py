"""Links among the members of buckets, verified on their whole sets, and the components they make.

A bucket of at most ``BLOCK`` members is compared in one task, which holds their sets as one sparse matrix and keeps a component label for
each: members of one component need no further comparison, and once the largest component is known, a link to another one has
an end outside the largest, so only members outside it are compared with all. A larger bucket is dealt out in blocks, each with
the bucket's hubs as guests, so that what resembles a hub is joined across blocks; what is then outside the bucket's largest component is
compared with all of the bucket, block against block, in one further stage. No bucket is capped, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import written
from tarn.operators.graph import components

#: Members that one task compares with each other at most, and items of theirs that it holds at most unless a single pair of blocks has more.
BLOCK = 512
#: Members of a large bucket that are guests in each of its blocks.
HUBS = 4
#: What rounding may do to a bound.
SLACK = 1e-9


class Labels:
    """A component label for each of some members, and the links that joined them."""

    def __init__(self, labels: np.ndarray) -> None:
        self.of = labels.copy()
        self.links: list[tuple[int, int]] = []

    def join(self, member: int, others: np.ndarray) -> None:
        """Join ``member`` with the components of ``others``, a link for each."""
        for label, first in zip(*np.unique(self.of[others], return_index=True), strict=True):
            if label != self.of[member]:
                self.of[self.of == label] = self.of[member]
                self.links.append((member, int(others[first])))


def _shared_counts(items: np.ndarray, sizes: np.ndarray):
    """A function that counts, for a member, the items it shares with each member."""
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    names, dense = np.unique(items, return_inverse=True)
    mark = np.zeros(len(names), bool)

    def of(member: int) -> np.ndarray:
        own = dense[starts[member] : starts[member] + sizes[member]]
        mark[own] = True
        out = np.add.reduceat(mark[dense], starts, dtype=np.int64)
        mark[own] = False
        return out

    def popularity() -> np.ndarray:
        return np.add.reduceat(np.bincount(dense)[dense].astype(float), starts) / sizes

    return of, popularity


def _linked(both: np.ndarray, sizes: np.ndarray, size: int, threshold: float) -> np.ndarray:
    return both >= threshold * (sizes + size - both) - SLACK


def spanning_links(items: np.ndarray, sizes: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that join all members whose sets (``items`` in a row, ``sizes`` of each) reach ``threshold`` directly or by way of others.

    The most typical members go first. Ends when all outside the largest component have been compared with all.
    """
    m = len(sizes)
    if m == 2:
        both = len(np.intersect1d(items[: sizes[0]], items[sizes[0] :], assume_unique=True))
        return [(0, 1)] if _linked(np.array([both]), sizes[1:], sizes[0], threshold)[0] else []
    shared, popularity = _shared_counts(items, sizes)
    order = np.argsort(-popularity(), kind="stable")
    state, done = Labels(np.arange(m)), np.zeros(m, bool)
    for _ in range(m):
        largest = np.bincount(state.of, minlength=m).argmax()
        open_ = order[~done[order] & (state.of[order] != largest)] if done.any() else order
        if not len(open_):
            break
        member = open_[0]
        done[member] = True
        state.join(member, np.flatnonzero(_linked(shared(member), sizes, sizes[member], threshold) & (state.of != state.of[member])))
    return state.links


def links_across(items: np.ndarray, sizes: np.ndarray, labels: np.ndarray, pivot: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links of the members that are ``pivot`` to members of other components, as far as they join any."""
    shared, _ = _shared_counts(items, sizes)
    state = Labels(labels)
    for member in np.flatnonzero(pivot):
        apart = state.of != state.of[member]
        if apart.any():
            state.join(member, np.flatnonzero(apart & _linked(shared(member), sizes, sizes[member], threshold)))
    return state.links


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Runs of rows with the same first column: that value, and for each other column its values (``items``: all in a row, and their sizes)."""
    held: list[pa.RecordBatch] = []

    def table(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        return {n: t.column(n).chunk(0) for n in t.column_names}

    for batch in batches:
        key = batch.column(0).to_numpy()
        if not len(key):
            continue
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(0)[0].as_py() != int(key[a]):
                yield table(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield table(held)


def _sets_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def _as_links(found: Iterator[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[bytes, bytes]] = []
    for pair in found:
        rows.append((min(pair), max(pair)))
        if len(rows) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["a", "b"])
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["a", "b"])


def _together(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with a ``gid`` in front, those of one side by side."""
    return rows.repartition("gid").sortWithinPartitions("gid", *order)


def _within(placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links within the groups of ``placed`` (``gid, node``)."""

    def run(batches):
        def found():
            for group in _groups(batches):
                items, sizes = _sets_of(group["items"])
                nodes = group["node"]
                for a, b in spanning_links(items, sizes, threshold) if len(sizes) > 1 else ():
                    yield nodes[a].as_py(), nodes[b].as_py()

        yield from _as_links(found())

    rows = placed.join(sets, "node").select("gid", "node", "items")
    return _together(rows, "node").mapInArrow(run, "a binary, b binary")


def _across(large: DataFrame, sets: DataFrame, comps: DataFrame, threshold: float) -> DataFrame:
    """Links of large buckets (``key, node, n``) between what is outside a bucket's largest component and the rest of it.

    Both sides are dealt into blocks by the size of their sets, and only blocks meet whose sizes allow a link.
    """
    known = large.join(sets.select("node", F.size("items").alias("size")), "node").join(comps, "node", "left")
    named = written(known.select("key", "node", "size", "n", F.coalesce("comp", "node").alias("comp")), "large")
    sums = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("many"))
    tops = sums.groupBy("key").agg(F.max(F.struct("many", "comp")).alias("t"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    # Blocks by size: within a class of sizes (a tenth apart) the members are dealt out by their hash.
    band = F.floor(F.log(F.col("size")) / F.log(F.lit(1.1)))
    open_ = named.join(tops.select("key", F.col("t.comp").alias("top")), "key").withColumn("band", band)
    counts = open_.groupBy("key", "band").agg(F.count(F.lit(1)).alias("members"), F.sum((F.col("comp") != F.col("top")).cast("long")).alias("rest"))
    dealt = open_.join(counts, ["key", "band"])
    half = BLOCK // 2
    part = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.ceil(F.col(n) / half), F.lit(1)))
    rest = dealt.where("comp != top").select("key", "node", "comp", "band", part("rest").alias("block"))
    every = dealt.select("key", "node", "comp", "band", part("members").alias("block"))
    # Sizes within the threshold of each other are at most so many classes apart.
    reach = int(np.ceil(np.log(1 / threshold) / np.log(1.1))) + 1
    blocks = lambda df: df.select("key", "band", "block").distinct()
    one, two = blocks(rest).alias("p"), blocks(every).alias("m")
    meet = one.join(two, (F.col("p.key") == F.col("m.key")) & (F.abs(F.col("p.band") - F.col("m.band")) <= reach))
    gid = F.xxhash64("p.key", "p.band", "p.block", "m.band", "m.block").alias("gid")
    meet = written(meet.select(gid, F.col("p.key").alias("key"), F.col("p.band").alias("pb"), F.col("p.block").alias("pk"), F.col("m.band").alias("mb"), F.col("m.block").alias("mk")), "meet")
    pivots = rest.join(meet.select("gid", "key", F.col("pb").alias("band"), F.col("pk").alias("block")), ["key", "band", "block"]).select("gid", "node", "comp", F.lit(True).alias("pivot"))
    others = every.join(meet.select("gid", "key", F.col("mb").alias("band"), F.col("mk").alias("block")), ["key", "band", "block"]).select("gid", "node", "comp", F.lit(False).alias("pivot"))
    rows = pivots.union(others).join(sets, "node").select("gid", "node", "comp", "pivot", "items")

    def run(batches):
        def found():
            for group in _groups(batches):
                items, sizes = _sets_of(group["items"])
                _, labels = np.unique(np.array(group["comp"].to_pylist(), object), return_inverse=True)
                for a, b in links_across(items, sizes, labels, group["pivot"].to_numpy(zero_copy_only=False), threshold):
                    yield group["node"][a].as_py(), group["node"][b].as_py()

        yield from _as_links(found())

    return _together(rows, "pivot", "node").mapInArrow(run, "a binary, b binary")


def bucket_components(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``node, comp`` of the graph of all links between nodes that share a bucket: pairs whose sets have a Jaccard similarity of ``threshold``.

    ``members`` (``key, node``) says who is in which bucket, ``sets`` (``node, items``, sorted and distinct) what each holds; give written
    tables. Buckets with the same members are compared once. Nodes without a link have no row.
    """
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = written(members.join(counts, "key").select("key", "node", "n"), "counted")
    small = counted.where(F.col("n") <= BLOCK).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    # At most BLOCK nodes in a list.
    cold = small.select("nodes").distinct().select(F.xxhash64("nodes").alias("gid"), F.explode("nodes").alias("node"))
    large = counted.where(F.col("n") > BLOCK)
    if large.isEmpty():
        return components(_within(cold, sets, threshold))
    blocks = F.ceil(F.col("n") / (BLOCK // 2))
    dealt = large.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).select(F.xxhash64("key", "block").alias("gid"), "node")
    # Any fixed members serve as hubs: the smallest hashes, found by a partial minimum.
    hub = large.groupBy("key", "n", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(HUBS)).alias("k")).agg(F.min("node").alias("node"))
    guests = hub.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select(F.xxhash64("key", "block").alias("gid"), "node")
    links = written(_within(cold.union(dealt.union(guests).distinct()), sets, threshold), "links")
    comps = written(components(links), "comps")
    more = written(_across(large, sets, comps, threshold), "links")
    return components(links.union(more)) if not more.isEmpty() else comps
