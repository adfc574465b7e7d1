"""Components of the links between members of buckets, in DataFrame expressions alone; nothing of the graph comes to the driver but counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import written
from tarn.operators.graph import components

#: Members of a bucket that are compared with all others in one round.
BLOCK = 32


def ordered(a: Column | str, b: Column | str) -> list[Column]:
    """Two nodes as ``a`` and ``b``, the smaller first."""
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


#: Parts that a node's shared items are counted in, by their remainder.
PARTS = 32


def shared_sizes(sets: DataFrame) -> DataFrame:
    """``node, n, s, parts``: a node's items, those that any other node of ``sets`` (``node, items``) has too, and how many of these lie in each of ``PARTS`` parts.

    The items are exchanged once; counts are partial before any other exchange.
    """
    part = F.pmod("item", F.lit(PARTS)).alias("part")
    each = sets.select("node", F.explode("items").alias("item"))
    alone = each.groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1")
    counts = each.groupBy("node", part).agg(F.count(F.lit(1)).alias("k")).union(alone.groupBy("node", part).agg((-F.count(F.lit(1))).alias("k")))
    of = counts.groupBy("node", "part").agg(F.sum("k").alias("k")).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("part", "k"))).alias("m"), F.sum("k").alias("s"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.coalesce(F.col("m")[p], F.lit(0)).cast("int"))
    return sets.select("node", F.size("items").alias("n")).join(of.select("node", "s", parts.alias("parts")), "node")


def bucket_components(members: DataFrame, sets: DataFrame, links_of: Callable[[DataFrame], DataFrame], threshold: float, block: int = BLOCK) -> DataFrame:
    """``node, comp`` of the graph of all links between nodes that share a bucket: pairs whose sets have a Jaccard similarity of ``threshold``.

    ``members`` (``key, node``) says who is in which bucket, ``sets`` (``node, items``) what each holds, ``links_of`` takes pairs (``a, b``) and
    returns the links. Both tables are read in every round, so give written ones. A bound that loses no link goes first: two sets
    share at most what either shares with any set at all, counted part by part, so a node with many items of its own can't link to
    anything of its size.

    A bucket's members are first compared with the one that shares the most. Where they aren't then one component, those outside the
    bucket's largest component are compared, ``block`` by block, with all that are in another one, until no such pair of any
    bucket is left: every link between two components has an end outside the largest. No bucket is capped, none expanded into all its pairs.
    """
    slack = 1e-9
    bounds = shared_sizes(sets).where(F.col("s") >= threshold * F.col("n") - slack)
    known = members.join(bounds, "node")
    least = known.groupBy("key").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("many")).where("many > 1").select("key", "least")
    able = F.col("s") >= threshold * (F.col("n") + F.greatest("least", "s") - F.col("s")) - slack
    kept = written(known.join(least, "key").where(able).select("key", "node", "n", "s", "parts"), "kept")
    # A node's buckets are few: with their list, a pair is made only in the first bucket that both are in.
    members = written(kept.join(kept.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys")), "node"), "able")

    def near(a: str, b: str) -> Column:
        """Whether two nodes may reach the threshold: part by part they share at most the fewer of their shared items."""
        both = F.aggregate(F.zip_with(f"{a}.parts", f"{b}.parts", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
        most = threshold * (F.col(f"{a}.n") + F.col(f"{b}.n")) - slack
        return (F.least(f"{a}.s", f"{b}.s") * (1 + threshold) >= most) & (both * (1 + threshold) >= most)

    hubs = members.groupBy("key").agg(F.max(F.struct((F.col("s") / F.col("n")).alias("share"), "node", "n", "s", "parts")).alias("h")).select(F.col("key").alias("hub_key"), "h.node", "h.n", "h.s", "h.parts")
    first = members.alias("m").join(hubs.alias("h"), (F.col("m.key") == F.col("hub_key")) & (F.col("m.node") != F.col("h.node")) & near("m", "h"))
    links = written(links_of(first.select(*ordered("m.node", "h.node")).distinct()), "links")
    comps = written(components(links), "comps")
    done = None
    while True:
        named = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key")
        open_ = written(named.join(mixed, "key"), "open")
        sizes = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("many"))
        largest = sizes.groupBy("key").agg(F.max(F.struct("many", "comp")).alias("top")).select("key", F.col("top.comp").alias("top"))
        rest = open_.join(largest, "key").where("comp != top")
        if done is not None:
            rest = rest.join(done, ["key", "node"], "left_anti")
        ranked = rest.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("node"))).where(F.col("rank") <= block)
        pivots = written(ranked.select("key", "node", "n", "s", "parts", "comp", "keys"), "pivots")
        if pivots.isEmpty():
            return comps
        both = pivots.alias("p").join(open_.alias("m"), (F.col("p.key") == F.col("m.key")) & (F.col("p.comp") != F.col("m.comp")) & near("p", "m") & (F.get(F.array_intersect("p.keys", "m.keys"), F.lit(0)) == F.col("p.key")))
        new = written(links_of(both.select(*ordered("p.node", "m.node")).distinct()), "links")
        used = pivots.select("key", "node")
        done = used if done is None else done.union(used)
        if not new.isEmpty():
            links = links.union(new)
            comps = written(components(links), "comps")
