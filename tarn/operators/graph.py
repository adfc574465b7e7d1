"""Graph operators in tables: components, pointer jumping, and sums down a tree, in logarithmically many rounds.

Joins of a graph with itself are merged: rounds are small as files and large in memory, so that Spark's estimate would have the driver broadcast them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.runtime import written


#: Edges or pointers, of whole numbers, that one task holds well (some 100 MB); more take rounds.
AT_ONCE = 1 << 20


def _joined(table: pa.Table) -> pa.Table:
    """``node, comp`` of edges ``a, b``: the larger of two roots is hung below the smaller until no edge leads from one to another."""
    ends = [table.column(c).to_numpy() for c in ("a", "b")]
    node, at = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = at[: len(ends[0])], at[len(ends[0]) :]
    root = np.arange(len(node))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return pa.table({"node": node, "comp": node[root]})


def _followed(table: pa.Table) -> pa.Table:
    """``node, next`` of pointers: the ends of all ways, null on cycles; nodes whose way leads out of the table are left out."""
    node, to = (table.column(c).to_numpy() for c in ("node", "next"))
    order = np.argsort(node)
    node, to = node[order], to[order]
    n = len(node)
    at = np.minimum(np.searchsorted(node, to), n - 1)
    at = np.append(np.where(node[at] == to, at, n), n)  # the last stands for what isn't there
    end = at == np.arange(n + 1)
    for _ in range(n.bit_length()):
        if end[at].all():
            break
        at = at[at]
    at = at[:n]
    there = at < n
    return pa.table({"node": node[there], "next": pa.array(node[at[there]], mask=~end[at[there]])})


def components(edges: DataFrame, at_once: int = 0) -> DataFrame:
    """``node, comp`` of every node of ``edges`` (``a, b``), comp being the smallest node that it is joined to; by star contraction.

    A round links the larger neighbours of a node, then the smaller ones, to the smallest of them, and the rounds end when
    nothing changes. Only a count and a checksum of the edges come to the driver. Up to ``at_once`` edges (of nodes that are long)
    are put together in one task instead.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if at_once and now.count() <= at_once:
        return now.groupBy().applyInArrow(_joined, "node long, comp long")
    before = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().where("a > b")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        new = large.join(lowest.hint("merge"), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        new = written(new, "edges")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, now = state, new
    return new.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(new.select(F.col("b"), F.col("b")).distinct())


def jump(pointers: DataFrame, at_once: int = 0) -> DataFrame:
    """Follow ``node -> next`` (null or itself: an end) to the end: ``node, next`` with the last node, each round doubling the steps.

    Nodes that run into a cycle have no end and come back with ``next`` null. Up to ``at_once`` pointers (of nodes that are long) are followed in one task.
    """
    now = written(pointers.select("node", F.coalesce("next", "node").alias("next")), "jump")
    ends = now.where("node = next").select(F.col("node").alias("next"), F.lit(True).alias("ended"))
    steps, most = 1, now.count()
    if most <= at_once:
        return now.groupBy().applyInArrow(_followed, "node long, next long")
    while steps <= most and not now.join(ends.hint("merge"), "next", "left_anti").isEmpty():
        two = now.select(F.col("node").alias("next"), F.col("next").alias("then"))
        now = written(now.join(two.hint("merge"), "next").select("node", F.col("then").alias("next")), "jump")
        steps *= 2
    return now.join(ends.hint("merge"), "next", "left").select("node", F.when(F.col("ended"), F.col("next")).alias("next"))


def downstream_sums(nodes: DataFrame, value: str = "value") -> DataFrame:
    """``node, total``: the ``value`` of a node and of all nodes that drain to it over ``node -> next`` (null: none).

    The members of a cycle all have the sum of everything that drains into the cycle or belongs to it. Sums double their reach each
    round: what a node has gathered from 2**k steps up goes 2**k steps down. Cycles are found as what doubling never ends, and are
    contracted to their smallest member first.
    """
    linked = written(nodes.select("node", "next", F.col(value).alias("v")), "linked")
    cyclic = _on_cycles(linked)
    name = linked.join(cyclic, "node", "left").select("node", "next", "v", F.coalesce("cycle", "node").alias("group"))
    of = name.select(F.col("node").alias("next"), F.col("group").alias("to"))
    hops = name.join(of, "next", "left").select("group", F.when(F.col("to") != F.col("group"), F.col("to")).alias("to"), "v")
    now = written(hops.groupBy("group").agg(F.sum("v").alias("total"), F.max("to").alias("to")), "sums")
    while not now.where("to is not null").isEmpty():
        sent = now.where("to is not null").groupBy(F.col("to").alias("group")).agg(F.sum("total").alias("more"))
        ahead = now.select(F.col("group").alias("to"), F.col("to").alias("then"))
        new = now.join(sent, "group", "left").join(ahead, "to", "left")
        now = written(new.select("group", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"), F.col("then").alias("to")), "sums")
    return name.select("node", "group").join(now, "group").select("node", "total")


def _on_cycles(linked: DataFrame) -> DataFrame:
    """``node, cycle`` (its smallest node) of the nodes on cycles of ``node -> next``: what is left when nodes that nothing drains to are taken away over and over, by doubling."""
    n = linked.count()
    now = written(linked.where("next is not null").select("node", "next"), "reach")
    steps = 1
    while steps < n and not now.isEmpty():  # the nodes that are still reached after n steps are on cycles
        two = now.select(F.col("node").alias("next"), F.col("next").alias("then"))
        now = written(now.join(two, "next").select("node", F.col("then").alias("next")), "reach")
        steps *= 2
    on = now.select(F.col("next").alias("node")).distinct()
    edges = linked.join(on, "node").select(F.col("node").alias("a"), F.col("next").alias("b"))
    alone = on.select("node", F.col("node").alias("cycle"))
    if on.isEmpty():
        return alone
    return alone.select("node").join(components(edges), "node", "left").select("node", F.coalesce("comp", "node").alias("cycle"))
