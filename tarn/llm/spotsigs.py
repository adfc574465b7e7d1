"""Document fingerprints by SpotSigs: chains of content words that follow common words.

An anchor is a common word of the text's languages. Its signature is the anchor and the next ``CHAIN`` words that aren't common,
``DISTANCE`` apart, hashed to 32 bits. A fingerprint is the set of a text's signatures, and likeness is the Jaccard similarity of two
sets. To find alike documents, sets are partitioned by their length so that only sets of one or two neighbouring partitions
can be alike; within them only sets that share one of their rarest signatures are compared, and lengths prune again.

All of it is DataFrame expressions. Words are runs of letters and digits of the lower-cased text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import texts, written
from tarn.llm.components import bucket_components

#: Common words of English, German, French and Spanish; a fixed value.
ANCHORS = (
    "the of and to in is that it for on was as by with be this are at from not have or an "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es "
    "de la le et les en des un une du dans est que pour qui par sur au pas avec "
    "el los y a las se del al lo una su con para como más"
)
DISTANCE, CHAIN = 1, 2
#: Documents that lie between two splitters of ``doc_id``, on average; and splitters at most.
ROWS_TOGETHER, MOST_BUCKETS = 1000, 1 << 16


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: the sorted distinct signatures of the column ``text``. A text without an anchor, or without content words behind it, has none."""
    common = F.array(*map(F.lit, sorted(set(ANCHORS.split()))))
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    out = df.withColumn("__words", words).withColumn("__common", F.transform("__words", lambda w: F.array_contains(common, w)))
    places = F.filter(F.sequence(F.lit(0), F.size("__words")), lambda i: F.get(F.col("__common"), i))
    content = F.filter(F.col("__words"), lambda w, i: ~F.get(F.col("__common"), i))
    out = out.withColumn("__places", places).withColumn("__content", content)

    def spot(place: Column, k: Column) -> Column:
        # Before the k-th anchor stand k anchors, all else are content words.
        chain = [F.get(F.col("__content"), place - k + DISTANCE * j - 1) for j in range(1, CHAIN + 1)]
        return F.when(chain[-1].isNotNull(), F.hash(F.get(F.col("__words"), place), *chain))

    found = F.array_sort(F.array_distinct(F.array_compact(F.transform("__places", spot))))
    return out.withColumn(name, found).drop("__words", "__common", "__places", "__content")


def likeness(a: str, b: str, same: Column) -> Column:
    """Jaccard similarity of two signature columns; of two empty ones 1 where the texts are the ``same``, else 0."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(same, 1.0).when(F.size(a) + F.size(b) == 0, 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _with_next(docs: DataFrame, key: str, *values: str) -> DataFrame:
    """Each row with the ``values`` of the next one by ``key`` (then by the values), the first after the last, as ``next_<value>``.

    Splitters of ``key`` part the rows into buckets, and the first rows of each bucket are copied behind the bucket before. So one
    exchange by bucket is enough, and no task orders more than a bucket. Splitters and bucket starts are a bounded list of numbers.
    """
    ids = docs.select(key)
    n = ids.count()
    side = max(1, math.isqrt(min(MOST_BUCKETS, n // ROWS_TOGETHER)))
    if n == 0:
        return docs.select("*", *(F.col(v).alias(f"next_{v}") for v in values))
    marks = [i / (side * side) for i in range(1, side * side)]
    cuts = sorted(ids.select(F.percentile_approx(key, marks, 100 * side * side)).first()[0]) if marks else []
    coarse = cuts[side - 1 :: side]
    fine = [cuts[i * side : i * side + side - 1] for i in range(side)]
    longs = lambda xs: F.lit(list(xs)).cast("array<bigint>") if xs else F.expr("cast(array() as array<bigint>)")
    at_most = lambda xs: F.size(F.filter(xs, lambda c: c <= F.col(key)))
    bucketed = docs.withColumn("__i", at_most(longs(coarse)))
    bucketed = bucketed.withColumn("__b", F.col("__i") * side + at_most(F.get(F.array(*map(longs, fine)), F.col("__i")))).drop("__i")
    starts = dict(bucketed.groupBy("__b").agg(F.min(key)).collect())
    used = sorted(starts)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    first = longs([starts.get(b, 0) for b in range(side * side)])
    previous = longs([before.get(b, b) for b in range(side * side)])
    here = F.struct(F.col("__b").cast("long").alias("b"), F.lit(False).alias("copy"))
    copy = F.struct(F.get(previous, F.col("__b")).alias("b"), F.lit(True).alias("copy"))
    dealt = bucketed.withColumn("__at", F.explode(F.when(F.col(key) == F.get(first, F.col("__b")), F.array(here, copy)).otherwise(F.array(here))))
    order = Window.partitionBy("__at.b").orderBy("__at.copy", key, *values)
    ahead = dealt.select("*", *(F.lead(v).over(order).alias(f"next_{v}") for v in values))
    return ahead.where("not __at.copy").drop("__b", "__at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text (null: empty) and its edited text, whose second half is the beginning of the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The last floor(n_chars / 2) code
    points give way to the first as many of the next document in ascending ``doc_id`` order, or to all it has; the first
    follows the last. Rows without ``doc_id`` come first, rows of one ``doc_id`` go by text. A single row follows itself. A
    fingerprint is the list of signatures, ascending, comma-joined; equal texts have equal ones and a likeness of 1; a text without
    signatures has an empty one, whose likeness to any other text is 0. Other columns are not used. An empty table gives none.
    """
    rows = texts(docs).withColumn("__key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    signed = with_signatures(rows, "text", "signs")
    # The two values of the next row: its text, and its signatures, so that they aren't made twice.
    ahead = _with_next(signed, "__key", "text", "signs")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = ahead.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    both = with_signatures(edited, "edited", "edited_signs")
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        joined("signs").alias("fingerprint"),
        joined("edited_signs").alias("edited_fingerprint"),
        likeness("signs", "edited_signs", F.col("text") == F.col("edited")).alias("near_edited"),
        likeness("signs", "next_signs", F.col("text") == F.col("next_text")).alias("near_next"),
    )


def alike_groups(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """``doc_id, class_id`` (smallest ``doc_id``): classes of documents joined by a likeness of ``threshold`` or more.

    Documents of equal fingerprints are one node. A document without signatures, or without ``doc_id``, is its own class. A node
    goes to its length's partition, and to the next, under each of its rarest signatures: as many as two sets with that likeness
    can't both lack.
    """
    rows = written(with_signatures(texts(docs), "text", "signs").select("doc_id", "signs", F.sha2(F.array_join(F.col("signs").cast("array<string>"), ","), 256).alias("node")), "signs")
    nodes = rows.where("doc_id is not null and size(signs) > 0").groupBy("node").agg(F.first("signs").alias("signs"))
    each = nodes.select("node", F.size("signs").alias("n"), F.explode("signs").alias("sign"))
    counted = each.join(each.groupBy("sign").agg(F.count(F.lit(1)).alias("df")), "sign")
    rare = counted.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("df", "sign"))).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    part = F.floor(F.log(F.col("n")) / -math.log(threshold))
    keyed = rare.withColumn("part", F.explode(F.array(part, part + 1))).select(F.xxhash64("part", "sign").alias("key"), "node").distinct()
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    members = written(keyed.join(shared, "key"), "members")
    sets = written(nodes, "sets")

    def links(pairs: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("node").alias(c), F.col("signs").alias(f"s{c}")) for c in "ab")
        full = pairs.join(one, "a").join(two, "b").where(F.least(F.size("sa"), F.size("sb")) >= threshold * F.greatest(F.size("sa"), F.size("sb")))
        return full.where(likeness("sa", "sb", F.lit(False)) >= threshold - 1e-9).select("a", "b")

    comps = bucket_components(members, sets.select("node", F.col("signs").alias("items")), links, threshold)
    named = rows.select("doc_id", "node", "signs").join(comps, "node", "left").select("doc_id", "signs", F.coalesce("comp", "node").alias("comp"))
    real = F.col("doc_id").isNotNull() & (F.size("signs") > 0)
    classes = named.where(real).groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    return named.withColumn("real", real).join(classes, "comp", "left").select("doc_id", F.when(F.col("real"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
