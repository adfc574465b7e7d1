"""Personal data by candidate gradient boosting: generators of high recall propose overlapping spans, boosted trees score them, calibrated thresholds select.

Spans of the four base kinds come from fixed patterns and their checks, and always stay. Further generators propose what those
patterns miss: spelled-out addresses, phones in any grouping, numbers of card length, other forms of addresses of machines, and
secrets (keys and tokens). Their patterns are wide on purpose and overlap each other. A candidate's format and the words before and behind
it are features of small boosted trees; it is selected if its calibrated probability reaches its kind's threshold, and of
overlapping candidates the surer one stays. The trees are fitted on the driver from ``TRAINING_ROWS`` generated examples, since no table has
labelled spans: one part fits, one calibrates, one sets the thresholds. All work on documents is in SQL expressions: split and
match by one pattern give the lengths from which positions follow.
"""

from __future__ import annotations

import random
import string
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import boosting

#: The kinds of base spans, then the one that only candidates have.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Generated examples: half fit the trees, a quarter calibrates, a quarter sets the thresholds; a bound on what the driver handles.
TRAINING_ROWS = 10_000
#: The share of true spans among those selected that a kind's threshold must reach on examples that neither fit nor calibrate.
PRECISION = 0.97
#: Characters before and behind a candidate that its features see.
LEFT, RIGHT = 40, 24

#: The base patterns, with possessive loops and a start only where a run starts (or the last match ended): the same leftmost
#: matches, found in linear time and without recursion on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried at all.
BASE_NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

_AT = r"(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20|@)"
_DOT = r"(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20|\.)"
#: Candidate generators: kind, pattern, need.
MORE = {
    "spelled": ("email", rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{2,64}}+{_AT}[a-z0-9-]{{2,63}}+(?:{_DOT}[a-z0-9-]{{2,63}}+){{1,6}}+", r"(?i)[(\[{\x20]at[)\]}\x20]|@"),
    "grouped": ("phone", r"(?<![0-9A-Za-z.+])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}+(?![0-9A-Za-z])", r"[0-9]{2}\)?[\x20./-]{1,2}[0-9]{2}"),
    "run": ("phone", r"(?<![0-9A-Za-z.])(?:00|\+)?[0-9]{7,15}+(?![0-9A-Za-z])", r"[0-9]{7}"),
    "long": ("card", r"(?<![0-9A-Za-z])[0-9](?:[\x20.-]?[0-9]){12,18}+(?![0-9A-Za-z])", r"[0-9]{2}[\x20.-]?[0-9]{2}"),
    "six": ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])", r"[0-9A-Fa-f]?:[0-9A-Fa-f]{0,4}:"),
    "defanged": ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\x20?[(\[]\.[)\]]\x20?[0-9]{1,3}){3}(?![0-9])", r"[(\[]\.[)\]]"),
    "token": ("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}", r"[A-Za-z0-9+/_-]{16}"),
}
#: Words about a span that speak for its kind.
CUES = {
    "email": "e-?mail|contact|write|reach|address|mail|send",
    "phone": "tel|phone|call|mobile|fax|contact|cell|whatsapp|dial|sms|reach",
    "card": "card|visa|amex|mastercard|credit|payment|debit|pay|charge",
    "ip": "ip|host|server|address|client|login|from|gateway|ping",
    "secret": "token|key|secret|password|passwd|pwd|auth|bearer|credential|api",
}
#: Words about a span that speak for a mere number or name.
AGAINST = "isbn|serial|order|version|figure|table|part|ref|page|sample|model|batch|section|mac|hash|equation|sha|commit|checksum|path|file|at|id|invoice|time|date|since"
FEATURES = ("before", "close", "behind", "against", "luhn", "digits", "separators", "brackets", "length", "letters", "capitals", "mixed", "repeats", "assigned", "year", *(f"by_{g}" for g in MORE))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


#: Matches whose lengths are summed up together, so that positions take a time in proportion to the matches.
_BLOCK = 64


def _found(text: Column, pattern: str, need: str) -> Column:
    """Matches of ``pattern`` in order: start and end (code points, end exclusive), the match, the characters before and behind it."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,match:string,left:string,right:string>>)")
    add = lambda a, b: a + b

    def placed(s: Column) -> Column:
        total = lambda k, n: F.aggregate(F.slice(s["steps"], k, n), F.lit(0), add)
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(s["matches"]) / _BLOCK).cast("int")), lambda b: total(b * _BLOCK + 1, F.lit(_BLOCK)))
        started = F.aggregate(blocks, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))

        def span(m: Column, i: Column, starts: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            start = F.get(starts, block) + total(block * _BLOCK + 1, i % _BLOCK) + F.length(F.get(s["pieces"], i))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"), F.right(F.get(s["pieces"], i), F.lit(LEFT)).alias("left"), F.left(F.get(s["pieces"], i + 1), F.lit(RIGHT)).alias("right"))

        return _let(started, lambda starts: F.transform(s["matches"], lambda m, i: span(m, i, starts)))

    def stepped(s: Column) -> Column:
        steps = F.transform(s["matches"], lambda m, i: F.length(F.get(s["pieces"], i)) + F.length(m))
        return _let(F.struct(s["pieces"].alias("pieces"), s["matches"].alias("matches"), steps.alias("steps")), placed)

    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(need), _let(F.struct(pieces.alias("pieces"), matches.alias("matches")), stepped)).otherwise(empty)


def _features(generator: str, kind: str, span: Column) -> list[Column]:
    """Numbers about a candidate's format and context, as ``FEATURES`` names them."""
    left, right, match = F.lower(span["left"]), F.lower(span["right"]), span["match"]
    digits = F.regexp_replace(match, "[^0-9]", "")
    letters = F.regexp_replace(match, "[^A-Za-z]", "")
    flags = (
        left.rlike(rf"\b(?:{CUES[kind]})\b[^\n]{{0,32}}$"),
        left.rlike(rf"(?:{CUES[kind]})[\W_]{{0,6}}$"),
        right.rlike(rf"^[^\n]{{0,16}}\b(?:{CUES[kind]})\b"),
        left.rlike(rf"\b(?:{AGAINST})\b[\W_]{{0,4}}(?:no|nr|is|of)?[\W_]{{0,4}}$"),
        F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False),
    )
    counts = (
        F.length(digits),
        F.length(F.regexp_replace(match, "[^ .:/-]", "")),
        F.length(F.regexp_replace(match, "[^()\\[\\]{}]", "")),
        F.length(match),
        F.length(letters),
        F.length(F.regexp_replace(match, "[^A-Z]", "")),
        # Turns between letters and digits, and characters that repeat the one before: random strings have many and few.
        F.length(F.regexp_replace(F.regexp_replace(match, "[0-9]++", "0"), "[^0]", "")),
        F.length(match) - F.length(F.regexp_replace(match, r"(.)\1+", "$1")),
    )
    more = (left.rlike(r"[=:]\s?[\"']?$"), match.rlike(r"^\(?(?:19|20)[0-9]{2}\b"))
    return [*(f.cast("double") for f in flags), *(c.cast("double") for c in counts), *(f.cast("double") for f in more), *(F.lit(float(g == generator)) for g in MORE)]


def _examples(seed: int = 7) -> list[tuple[str, str, int]]:
    """Generated texts with one candidate each, its kind, and whether it is personal data.

    True spans and look-alikes share most of their forms, and both come after fitting, opposing and neutral words, in different shares:
    no single feature tells them apart.
    """
    rng = random.Random(seed)
    pick = rng.choice
    n = lambda k: "".join(pick(string.digits) for _ in range(k))
    word = lambda: "".join(pick("bcdfglmnprst") + pick("aeiou") for _ in range(rng.randint(2, 4)))
    anyof = lambda chars, k: "".join(pick(chars) for _ in range(k))

    def card(k: int) -> str:
        body = n(k - 1)
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def cut(digits: str, groups: list[int], by: str) -> str:
        at = np.cumsum([0, *groups])
        return by.join(digits[a:b] for a, b in zip(at, at[1:], strict=False))

    def email(true: bool) -> str:
        at = pick((" (at) ", " [at] ", "(at)", " at ")) if true or rng.random() < 0.3 else " at "
        dot = pick((" (dot) ", " [dot] ", ".", " dot "))
        return f"{word()}{at}{word()}{dot}{pick(('com', 'org', 'net', 'de', 'fr')) if true else pick(('com', word(), word()))}"

    def phone(true: bool) -> str:
        if true:
            return pick((f"({n(3)}) 555-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"0{n(2)} {n(2)} {n(2)} {n(2)} {n(2)}", f"0{n(3)}/{n(7)}", f"00{n(11)}", n(10), f"{n(3)}.{n(3)}.{n(4)}", f"{n(3)} {n(3)} {n(4)}"))
        return pick((f"{n(2)}.{n(2)}.20{n(2)}", f"20{n(2)}-{n(2)}-{n(2)}", f"{n(4)}-{n(4)}", f"{n(3)} {n(3)} {n(3)}", n(8), n(10), f"{n(2)}.{n(2)}", f"{n(3)}-{n(2)}-{n(5)}", f"{n(3)} {n(3)} {n(4)}", f"{n(3)}-{n(3)}-{n(4)}"))

    def number(true: bool) -> str:
        digits = card(pick((15, 16, 16, 14))) if true else pick((n, card))(pick((13, 15, 16, 17))) if rng.random() < 0.2 else n(pick((13, 14, 15, 16, 17, 18)))
        return digits if rng.random() < 0.5 or len(digits) < 15 else cut(digits, [4, 6, len(digits) - 10] if len(digits) == 15 else [4, 4, 4, len(digits) - 12], pick(" -."))

    def machine(true: bool) -> str:
        hexes = lambda k: ":".join(anyof("0123456789abcdef", rng.randint(1, 4)) for _ in range(k))
        if true:
            return pick((hexes(8), f"fe80::{hexes(3)}", f"2001:{hexes(3)}::{hexes(2)}", "[.]".join(str(rng.randrange(256)) for _ in range(4))))
        return pick((f"{n(2)}:{n(2)}:{n(2)}", ":".join(anyof("0123456789ABCDEF", 2) for _ in range(6)), f"{n(1)}:{n(2)}:{n(2)}", "[.]".join(n(3) for _ in range(4))))

    def long_word() -> str:
        return "".join(word() + pick(("", "n", "st", "ng", "ch", "r")) for _ in range(rng.randint(3, 5))).ljust(16, "e")

    def secret(true: bool) -> str:
        if true:
            return pick((anyof("0123456789abcdef", pick((32, 40, 64))), anyof(string.ascii_letters + string.digits, rng.randint(20, 48)), "sk-" + anyof(string.ascii_letters + string.digits, 40), "AKIA" + anyof(string.ascii_uppercase + string.digits, 16)))
        return pick((anyof("0123456789abcdef", pick((32, 40, 64))), "-".join(word() for _ in range(4)), "/".join(word() for _ in range(4)), word() + word() + word() + word(), "_".join((word(), word(), word(), n(2))), n(rng.randint(16, 24)), "-" * rng.randint(16, 40), long_word(), long_word().upper(), long_word().title() + word()))

    make = {"email": email, "phone": phone, "card": number, "ip": machine, "secret": secret}
    cues = {k: [w.replace("e-?mail", "email") for w in v.split("|")] for k, v in CUES.items()}
    against = AGAINST.split("|")
    rows = []
    for i in range(TRAINING_ROWS):
        kind, true = list(make)[i % len(make)], rng.random() < 0.5
        cue = rng.random()
        before = pick(cues[kind]) if cue < (0.7 if true else 0.08) else pick(against) if cue > (0.97 if true else 0.6) else word()
        joint = pick((" ", ": ", " = ", '="', " is ", " no. ", f" {word()} "))
        behind = pick((f" {pick(cues[kind])}", f" {word()}")) if true and rng.random() < 0.1 else pick((f" {word()}", ".", ", " + word(), "\n" + word()))
        rows.append((f"{word()} {word()} {before}{joint}{make[kind](true)}{behind} {word()}", kind, int(true)))
    return rows


_MODELS: dict[tuple, dict] = {}


def candidates(examples: DataFrame) -> DataFrame:
    """``place, y, kind`` of examples (``place, text, kind, y``) with ``x``, the features of each candidate of their kind."""
    parts = []
    for generator, (kind, pattern, need) in MORE.items():
        span = F.explode(_found(F.col("text"), pattern, need)).alias("s")
        parts.append(examples.where(F.col("kind") == kind).select("place", "y", "kind", span).select("place", "y", "kind", F.array(*_features(generator, kind, F.col("s"))).alias("x")))
    return reduce(DataFrame.unionAll, parts)


def fitted(spark: SparkSession) -> dict[str, tuple[boosting.Boosted, float]]:
    """For each kind its trees and their threshold, infinite where none reaches ``PRECISION``; fitted once in a driver process."""
    key = (TRAINING_ROWS, PRECISION)
    if key not in _MODELS:
        made = spark.createDataFrame([(i, *r) for i, r in enumerate(_examples())], "place long, text string, kind string, y int")
        got = sorted(candidates(made).collect(), key=lambda r: (r["place"], r["x"]))
        models = {}
        for kind in KINDS:
            own = [r for r in got if r["kind"] == kind]
            x, y, part = np.array([r["x"] for r in own]), np.array([r["y"] for r in own], float), np.array([r["place"] // len(KINDS) % 4 for r in own])
            model = boosting.calibrate(boosting.fit(x[part < 2], y[part < 2]), x[part == 2], y[part == 2])
            models[kind] = model, boosting.threshold(model.probability(x[part == 3]), y[part == 3], PRECISION)
        _MODELS[key] = models
    return _MODELS[key]


def _passes(kind: str):
    return lambda s: _valid(kind, s["match"])


def _reaching(cut: float):
    return lambda s: s["p"] >= cut


def _with_features(generator: str, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *(x.alias(n) for x, n in zip(_features(generator, kind, s), FEATURES, strict=True)))


def _resolved(spans: Column) -> Column:
    """Spans (start, end, kind, p) by start, base ones with p 2, of which all base ones stay, and of overlapping candidates the surer of two neighbours."""
    kind = "struct<start:int,end:int,kind:int,p:double>"
    none = F.expr(f"cast(null as {kind})")
    state = F.struct(F.expr(f"cast(array() as array<{kind}>)").alias("out"), none.alias("held"), F.lit(0).alias("edge"))

    def step(acc, s):
        held = acc["held"]
        apart = held.isNull() | (held["end"] <= s["start"])
        settled = F.when(held.isNotNull() & apart, F.concat(acc["out"], F.array(held))).otherwise(acc["out"])
        base = F.struct(F.concat(settled, F.array(s)).alias("out"), none.alias("held"), F.greatest(acc["edge"], s["end"]).alias("edge"))
        fresh = F.struct(settled.alias("out"), s.alias("held"), acc["edge"].alias("edge"))
        better = F.struct(acc["out"].alias("out"), F.when(s["p"] > held["p"], s).otherwise(held).alias("held"), acc["edge"].alias("edge"))
        return F.when(s["p"] > 1, base).when(s["start"] < acc["edge"], acc).when(apart, fresh).otherwise(better)

    done = F.aggregate(F.array_sort(spans), state, step)
    return _let(done, lambda d: F.when(d["held"].isNull(), d["out"]).otherwise(F.concat(d["out"], F.array(d["held"]))))


def _spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text`` and others) with ``base``, the base spans (start, end, kind's number, 2.0) of each kind in one array each, and ``every``, base and selected ones by start."""
    models = fitted(docs.sparkSession)
    out = docs
    spans = lambda kind, found: F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), F.lit(2.0).alias("p")))
    for kind in BASE_KINDS:
        out = out.withColumn(f"base_{kind}", spans(kind, F.filter(_found(F.col("text"), BASE[kind], BASE_NEEDS[kind]), _passes(kind))))
    more = []
    for generator, (kind, pattern, need) in MORE.items():
        model, cut = models[kind]
        if cut == float("inf"):
            continue
        out = out.withColumn(f"by_{generator}", F.transform(_found(F.col("text"), pattern, need), _with_features(generator, kind)))
        score = model.sql([f"s.{n}" for n in FEATURES])
        scored = F.expr(f"transform(by_{generator}, s -> struct(s.start as start, s.end as end, {KINDS.index(kind)} as kind, {score} as p))")
        more.append(F.filter(scored, _reaching(cut)))
    base = F.concat(*(f"base_{k}" for k in BASE_KINDS))
    return out.withColumn("every", _resolved(F.concat(base, *more)))


def _joined(spans: Column) -> Column:
    """``kind:start:end`` of spans by kind, start and end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text (null: empty): ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    ``n_`` count the base spans; ``base_sha256`` is of their list, ``spans`` is the list of all: ``kind:start:end`` by kind, then
    start, comma-joined, in code points with the end exclusive. Base spans may overlap each other; selected ones overlap none. A text
    without any has counts of 0 and an empty list. Repeated rows and null ids are kept; other columns are not used. One pass, no
    shuffle, no Python on executors.
    """
    found = _spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = F.concat(*(f"base_{k}" for k in BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]`` or ``[SECRET]``, and ``n_chars``, if there, set to the new length.

    Of overlapping spans the first to start gives the name, and all they cover goes. Texts without spans, null ones too, stay as they are.
    Columns may have any names: the row travels as one value.
    """
    columns = docs.columns
    found = _spans(docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text")))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc, s):
        kept = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(kept, F.get(names, s["kind"]))).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(longer)

    done = F.aggregate("every", state, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    out = found.select("row", F.when(F.size("every") > 0, done).alias("new"))
    fields = {c: F.col("row").getField(c).alias(c) for c in columns}
    fields["text"] = F.coalesce("new", "row.text").alias("text")
    if "n_chars" in columns:
        fields["n_chars"] = F.when(F.col("new").isNotNull(), F.length("new").cast("long")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*(fields[c] for c in columns))
