"""Exact dedup by content sort: sampled splitters deal the normalised bytes out by range, a sort puts equals side by side, neighbours are compared in full.

Equal texts have equal sort keys, so they meet in one range, and the comparison of neighbours there decides. Only texts that a
count shows to be hot are dealt out over several ranges, as parts; the first rows of their parts, few and bounded in number, are
then compared by their whole texts as well. Hashes only steer rows; none decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import ascii_lower, written

#: Characters of the text that a splitter holds at most. Splitters only deal rows out; the comparison is of whole texts.
SPLITTER_CHARS = 64
#: A text is hot if it has more rows than both the first number and the table's rows over the second. So there are fewer than
#: ``MOST_PARTS`` hot texts, and fewer than twice as many parts, whatever the size of the table: few enough to be broadcast.
HOT_ROWS, MOST_PARTS = 256, 1 << 16

#: What rows are dealt out by: the text's own keys, and for hot texts a salt behind them.
_KEYS, _SALTED = ("head", "hash"), ("head", "hash", "salt")


def _normal() -> Column:
    return ascii_lower(F.coalesce("text", F.lit("")))


def _hot(docs: DataFrame) -> DataFrame:
    """``hash, parts`` of the texts that are hot: a bounded table, see ``MOST_PARTS``."""
    many = written(docs.groupBy(F.xxhash64(_normal()).alias("hash")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > HOT_ROWS), "hot")
    most = max(HOT_ROWS, docs.count() // MOST_PARTS)
    return many.where(F.col("rows") > most).select("hash", F.ceil(F.col("rows") / most).alias("parts"))


def _sorted_rows(keyed: DataFrame, keys: tuple[str, ...], *, carry: bool) -> DataFrame:
    """Rows (``doc_id, row`` or ``text``, and the keys) in ranges sorted by ``keys``, with ``text`` (normalised)``, nth`` (of the different texts of these keys)``, place, n, best``.

    A splitter is (first characters, 64-bit hash) of the normalised text, and a salt where there is one, so samples on the driver are small and long common
    beginnings don't meet. ``place`` 1 is the largest document id among equal neighbours, ``n`` their number and ``best`` that id.
    """
    dealt = keyed.repartitionByRange(*keys)
    if carry:
        # The normalised text is made anew behind the exchange, not sent as well.
        dealt = dealt.withColumn("text", ascii_lower(F.coalesce("row.text", F.lit(""))))
    equal = Window.partitionBy(*keys, "text").orderBy(F.desc("doc_id"))
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = dealt.withColumn("place", F.row_number().over(equal)).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("best", F.first("doc_id").over(whole))
    return placed.withColumn("nth", F.dense_rank().over(Window.partitionBy(*keys).orderBy("text")))


def _split(docs: DataFrame, *, carry: bool) -> tuple[DataFrame, DataFrame | None]:
    """Sorted rows of all texts but the hot ones, and of the hot ones, dealt out by a salt; None if there are none.

    The salt of a row follows its place in its input partition, so that rows that agree in everything are dealt out too; a scan makes
    the same ones if it is repeated.
    """
    norm = _normal()
    sent = F.struct(*docs.columns).alias("row") if carry else norm.alias("text")
    keyed = docs.select("doc_id", sent, F.substring(norm, 1, SPLITTER_CHARS).alias("head"), F.xxhash64(norm).alias("hash"), F.monotonically_increasing_id().alias("at"))
    hot = _hot(docs)
    names = ["doc_id", "row" if carry else "text", "head", "hash"]
    if hot.isEmpty():
        return _sorted_rows(keyed.select(*names), _KEYS, carry=carry), None
    few = F.broadcast(hot)
    cold = keyed.join(few, "hash", "left_anti").select(*names)
    warm = keyed.join(few, "hash").select(*names, F.pmod("at", "parts").cast("long").alias("salt"))
    return _sorted_rows(cold, _KEYS, carry=carry), _sorted_rows(warm, _SALTED, carry=carry)


def _merged(firsts: DataFrame) -> DataFrame:
    """For each part of a hot text (``hash, salt, nth``): ``keep_id`` and ``won`` (whether its first row is the one that stays) and the text's rows, ``size``.

    ``firsts`` are the first rows of the parts, with their texts, which decide who belongs together.
    """
    parts = firsts.select("hash", "salt", "nth", "text", "best", "n")
    winner = F.max(F.struct("best", "hash", "salt", "nth")).alias("w")
    whole = parts.groupBy("text").agg(winner, F.sum("n").alias("size"))
    back = parts.join(whole, "text")
    won = F.struct("hash", "salt", "nth") == F.struct("w.hash", "w.salt", "w.nth")
    return back.select("hash", "salt", "nth", F.col("w.best").alias("keep_id"), won.alias("won"), "size")


def exact_groups(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z only; a null text is an empty one. Of equal texts the largest
    ``doc_id`` stays. A row without ``doc_id`` loses to any other; where all lack one, ``keep_id`` is null and one stays.
    Of rows that repeat one ``doc_id`` with one text, one stays. Other columns are not used. An empty table gives none.
    """
    cold, warm = _split(docs.select("doc_id", "text"), carry=False)
    out = cold.select("doc_id", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), (F.col("place") == 1).alias("kept"), F.sha2("text", 256).alias("text_sha256"))
    if warm is None:
        return out
    # Texts are kept for the first rows of parts alone.
    slim = warm.select("doc_id", "hash", "salt", "nth", "place", "n", "best", F.sha2("text", 256).alias("sha"), F.when(F.col("place") == 1, F.col("text")).alias("text"))
    groups = written(slim, "exact-groups")
    merged = F.broadcast(_merged(groups.where("place = 1")))
    rows = groups.join(merged, ["hash", "salt", "nth"])
    return out.union(rows.select("doc_id", "keep_id", F.col("size").alias("group_size"), ((F.col("place") == 1) & F.col("won")).alias("kept"), F.col("sha").alias("text_sha256")))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns, whatever their names.

    Of hot texts only the first rows of their parts are written, a bounded number, and the parts that lose are taken away.
    """
    cold, warm = _split(docs, carry=True)
    out = cold.where("place = 1").select("row.*")
    if warm is None:
        return out
    firsts = written(warm.where("place = 1").select("row", "hash", "salt", "nth", "text", "best", "n"), "exact-rows")
    won = F.broadcast(_merged(firsts).where("won").select("hash", "salt", "nth"))
    return out.union(firsts.join(won, ["hash", "salt", "nth"], "left_semi").select("row.*"))
