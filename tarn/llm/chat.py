"""Chat formatting by perspective: for every participant the dialogue with that speaker as the assistant and all others as named users.

A conversation is never gathered: each message is rendered in a row of its own for each participant, with the place it has in the
rendered dialogue and whether it is trained on. ``assembled`` joins the rows of chosen conversations where a whole text is wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns that are summed up together; parts, by the first digits of a hash, in which the messages of one turn and role are ordered.
CHUNK, PART_DIGITS = 256, 2
START, END = "<|im_start|>", "<|im_end|>\n"
#: What opens a mark, and how it is written where a message holds it, so that no message can end itself and speak for others.
MARK, PLAIN = "<|im_", "< |im_"
#: Roles that are nobody's perspective: their messages set the scene.
SCENE = ("system",)


def perspectives(conversations: DataFrame) -> DataFrame:
    """A row for each message and each participant of its conversation, as that participant sees it.

    ``conv_id, perspective, turn, seen_as, content, masked, start, length``: ``content`` is the message as rendered, ``seen_as`` its heading
    (``assistant``, ``user name=<role>`` or ``system``), ``masked`` whether it is left out of the loss (all but the assistant's), ``start`` where
    it begins in the rendered dialogue and ``length`` its code points. Participants are the distinct roles but ``SCENE``; a conversation of
    scenes alone has none and gives no row. Messages go by turn, then role, then the MD5 of their text, then text; nulls first. A null role speaks as
    ``unknown``, a null text is empty; messages without a ``conv_id`` are left out. Marks of the format within a message or a role are broken by a space, line ends in
    roles become spaces. Repeated messages are repeated. Other columns are not used.

    Messages that agree in everything are counted before any exchange. Places are sums on three levels: within a part of a turn's
    messages of one role, over the parts of a chunk of turns, and over the chunks. So neither a conversation nor a turn (nor no turn) that very many messages
    have is ordered by one task.
    """
    role = F.translate(F.replace(F.coalesce("role", F.lit("unknown")), F.lit(MARK), F.lit(PLAIN)), "\n", " ")
    plain = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(PLAIN)).alias("text"))
    said = plain.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    people = plain.where(~F.col("role").isin(*SCENE)).select("conv_id", F.col("role").alias("perspective")).distinct()
    place = F.coalesce("turn", F.lit(-(1 << 62)))
    rows = said.join(people, "conv_id").withColumn("place", place).withColumn("chunk", F.floor(F.col("place") / CHUNK)).withColumn("hash", F.md5("text")).withColumn("part", F.substring("hash", 1, PART_DIGITS))
    own = F.col("role") == F.col("perspective")
    seen = F.when(F.col("role").isin(*SCENE), F.col("role")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.col("role")))
    rows = rows.withColumn("seen_as", seen).withColumn("content", F.concat(F.lit(START), "seen_as", F.lit("\n"), "text", F.lit(END))).withColumn("length", F.length("content").cast("long"))
    rows = rows.withColumn("all", F.col("length") * F.col("times"))
    whole = ["conv_id", "perspective"]
    keys = [*whole, "chunk", "place", "role", "part"]
    before = lambda by, *order: F.coalesce(F.sum("all").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy(*keys).agg(F.sum("all").alias("all"))
    chunks = parts.groupBy(*whole, "chunk").agg(F.sum("all").alias("all")).withColumn("far", before(whole, "chunk")).drop("all")
    bases = parts.withColumn("near", before([*whole, "chunk"], "place", "role", "part")).join(chunks, [*whole, "chunk"]).select(*keys, (F.col("far") + F.col("near")).alias("base"))
    placed = rows.withColumn("inside", before(keys, "hash", "text")).join(bases, keys)
    each = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    start = F.col("base") + F.col("inside") + F.col("nth") * F.col("length")
    return each.select("conv_id", "perspective", "turn", "seen_as", "content", (~own).alias("masked"), start.alias("start"), "length")


def assembled(rendered: DataFrame) -> DataFrame:
    """Whole dialogues of ``perspectives``: ``conv_id, perspective, text``, and ``spans``, the (start, end) that are trained on. For conversations that fit a task."""
    parts = F.array_sort(F.collect_list(F.struct("start", "length", "masked", "content")))
    out = rendered.groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    spans = F.transform(F.filter("parts", lambda p: ~p["masked"]), lambda p: F.struct(p["start"].alias("start"), (p["start"] + p["length"]).alias("end")))
    return out.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda p: p["content"]), "").alias("text"), spans.alias("spans"))


ORACLE_SQL = """
    WITH m AS (SELECT conv_id, turn, replace(replace(coalesce(role, 'unknown'), '<|im_', '< |im_'), chr(10), ' ') AS role, replace(coalesce(text, ''), '<|im_', '< |im_') AS text FROM conversations WHERE conv_id IS NOT NULL),
    p AS (SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role <> 'system'),
    r AS (SELECT m.*, perspective, CASE WHEN role = 'system' THEN role WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END AS seen_as FROM m JOIN p USING (conv_id)),
    c AS (SELECT *, '<|im_start|>' || seen_as || chr(10) || text || '<|im_end|>' || chr(10) AS content FROM r)
    SELECT conv_id, perspective, turn, seen_as, content, role <> perspective AS masked,
           coalesce(sum(length(content)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, md5(text), text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
           length(content) AS length
    FROM c"""
