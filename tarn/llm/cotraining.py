"""A quality classifier by co-training: a view of the text and a view of what is known about the page teach each other.

Each view has boosted trees of its own. In every round each view scores all documents and names those that it is most sure of, and
the other view learns from them. At the end each view is calibrated on labelled rows that neither has learned from, a
logistic regression on the same rows weighs the two, and the result scores all documents in one pass.

The labelled sample (``LABELLED_ROWS``) and what a view hands over in a round (``HANDED`` of a class) are bounded, since the trees are
fitted on the driver; what is handed over are the surest of the whole table, not of a sample.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import boosting
from tarn.llm.common import small_batches, texts, written
from tarn.llm.spotsigs import ANCHORS

#: Labelled rows that the trees are fitted and calibrated on, half each.
LABELLED_ROWS = 4000
#: Rounds of exchange, rows of each class that a view hands over in a round, and how sure it must be.
ROUNDS, HANDED, SURE = 3, 200, 0.97
#: Documents stay whose score reaches what this share of the good held-out rows doesn't, and in any case one half.
LOSS = 0.01
#: Words are told apart by so many buckets of their hashes.
BUCKETS = 1 << 14

_LETTERS = [*range(65, 91), *range(97, 123), *range(128, 256)]
_GROUPS = np.zeros((256, 6))
for _k, _own in enumerate((_LETTERS, range(65, 91), range(48, 58), b"$%&*#@^~<>|=+{}[]\\/_", b".,;:!?", b" \n\t")):
    _GROUPS[list(_own), _k] = 1
_COMMON = frozenset(ANCHORS.split())


def text_features(text: str) -> list[float]:
    """The text's view but for its words: kinds of characters, lengths, shapes of words, and how much repeats."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters, upper, digits, symbols, stops, spaces = (counts @ _GROUPS) / max(1, len(data))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    kinds = Counter(words)
    capitals = bare = doubled = common = 0
    for w, many in kinds.items():
        capitals += many * (len(w) > 1 and w.isupper())
        bare += many * (not any(map(str.isalnum, w)))
        doubled += many * (len(w) > 1 and w[-1] == w[-2] and not w[-1].isalnum())
        common += many * (w.lower() in _COMMON)
    shares = [capitals / n, bare / n, doubled / n, common / n, sum(map(eq, words, words[1:])) / n]
    return [letters, upper / max(letters, 1e-9), digits, symbols, stops, spaces, len(data) / n, np.log1p(n), len(kinds) / n**0.9, max(kinds.values(), default=0) / n, len(set(lines)) / len(lines), *shares]


def word_buckets(text: str) -> list[int]:
    """The distinct buckets of a text's lower-cased words, sorted."""
    return sorted({xxhash.xxh32_intdigest(w) % BUCKETS for w in set(text.lower().split())})


def page_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """The view of what is known about the page: language, source and stated length."""
    bits = lambda s, n: [float(xxhash.xxh64_intdigest(s or "") >> k & 1) for k in range(n)]
    return [*bits(lang, 6), float(lang is None), *bits(source, 8), float(source is None), np.log1p(max(0, n_chars or 0)), float(n_chars is None)]


def word_weights(buckets: list[list[int]], y: np.ndarray) -> np.ndarray:
    """For each bucket the log odds that a good text has it over those of another, smoothed."""
    have = np.zeros((2, BUCKETS))
    for own, label in zip(buckets, y, strict=True):
        have[int(label), own] += 1
    many = np.array([(y == 0).sum(), (y == 1).sum()], float)[:, None]
    share = (have + 1) / (many + 2)
    return np.log(share[1]) - np.log(share[0])


def word_score(weights: np.ndarray, buckets: list[int]) -> float:
    return float(weights[buckets].mean()) if buckets else 0.0


def crossed_scores(buckets: list[list[int]], y: np.ndarray, folds: int = 5) -> np.ndarray:
    """Word scores of labelled rows by the weights of the rows in other folds, so that no row is scored by its own label."""
    place, out = np.arange(len(y)) % folds, np.zeros(len(y))
    for k in range(folds):
        rest, own = np.flatnonzero(place != k), np.flatnonzero(place == k)
        weights = word_weights([buckets[i] for i in rest], y[rest])
        out[own] = [word_score(weights, buckets[i]) for i in own]
    return out


@dataclass
class Model:
    """Two calibrated views, the weights of words and of the views' margins, and the least score that is kept; ``None`` in place of a view scores every document 1."""

    text: boosting.Boosted | None
    page: boosting.Boosted | None
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    keep: float = 0.5
    words: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))

    def scores(self, x_text: np.ndarray, x_page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: by the text, by the page, by both."""
        if self.text is None or self.page is None:
            one = np.ones(len(x_text))
            return one, one, one
        p, q = self.text.probability(x_text), self.page.probability(x_page)
        a, b, c = self.weights
        return p, q, _sigmoid(a * _logit(p) + b * _logit(q) + c)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _stacked(p: np.ndarray, q: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of both views' margins and a constant, by Newton steps towards the text's own opinion."""
    design = np.stack([_logit(p), _logit(q), np.ones(len(y))], 1)
    w = np.array([1.0, 0.0, 0.0])
    for _ in range(50):
        s = _sigmoid(design @ w)
        gradient = design.T @ (s - y) + 1.0 * (w - [1, 0, 0])
        w = w - np.linalg.solve((design * (s * (1 - s))[:, None]).T @ design + np.eye(3), gradient)
    return tuple(map(float, w))


def co_train(views: list[np.ndarray], y: np.ndarray, surest) -> tuple[boosting.Boosted, boosting.Boosted] | None:
    """Both views, fitted on half of the labelled rows and on each other's sure guesses, and calibrated on the other half; None without both classes in both halves.

    ``surest(models)`` gives for each giver and label the features (of both views) of the rows that it is surest of, none twice to one taker.
    """
    half = np.arange(len(y)) % 2 == 0
    if len(set(y[half])) < 2 or len(set(y[~half])) < 2:
        return None
    known = [(x[half], y[half]) for x in views]
    calibrated = lambda: [boosting.calibrate(boosting.fit(*k), x[~half], y[~half]) for k, x in zip(known, views, strict=True)]
    models = calibrated()
    for _ in range(ROUNDS):
        for (giver, label), rows in surest(models).items():
            x, t = known[1 - giver]
            known[1 - giver] = np.concatenate([x, rows[1 - giver].reshape(-1, x.shape[1])]), np.concatenate([t, np.full(len(rows[0]), label)])
        models = calibrated()
    return models[0], models[1]


def _known(docs: DataFrame) -> DataFrame:
    """``docs`` with ``lang``, ``source`` and ``n_chars`` where it has them, else nulls; other columns are left out."""
    have = set(docs.columns)
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    return docs.select("doc_id", "text", *((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


def _views(batch: pa.RecordBatch, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch with ``text, lang, source, n_chars``."""
    c = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("text", "lang", "source", "n_chars")}
    x = np.array([[*text_features(t or ""), word_score(words, word_buckets(t or ""))] for t in c["text"]]).reshape(batch.num_rows, -1)
    z = np.array([page_features(*r) for r in zip(c["lang"], c["source"], c["n_chars"], strict=True)]).reshape(batch.num_rows, -1)
    return x, z


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0), pa.array(x.ravel(), pa.float64()))


def _labelled(docs: DataFrame, labels: DataFrame) -> tuple[list[list[float]], list[list[int]], list[list[float]], np.ndarray]:
    """Text features, word buckets, page features and labels of at most ``LABELLED_ROWS`` rows of documents that have a label: those of the smallest hashes."""
    order = [F.xxhash64("doc_id", F.lit(9)), F.col("doc_id")]
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    # At most LABELLED_ROWS ids: small enough to send to every scan of the texts. An id that many rows have is bounded once more behind it.
    chosen = marked.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(*order).limit(LABELLED_ROWS)
    rows = _known(docs).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in small_batches(batches):
            c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            x = [text_features(t or "") for t in c["text"]]
            b = [word_buckets(t or "") for t in c["text"]]
            z = [page_features(*r) for r in zip(c["lang"], c["source"], c["n_chars"], strict=True)]
            key = [xxhash.xxh64_intdigest(f"{d}:{t}") >> 1 for d, t in zip(c["doc_id"], c["text"], strict=True)]
            kinds = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((key, c["y"], x, b, z), kinds, strict=True)], ["key", "y", "x", "b", "z"])

    found = rows.select("doc_id", "y", "text", "lang", "source", "n_chars").mapInArrow(run, "key long, y double, x array<double>, b array<int>, z array<double>")
    got = found.orderBy("key", "x", "z").limit(LABELLED_ROWS).collect()
    return [r["x"] for r in got], [r["b"] for r in got], [r["z"] for r in got], np.array([r["y"] for r in got])


def _pool(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """``key`` (a hash of the row's id and features)``, x, z`` of every row of ``docs``."""

    def run(batches):
        for batch in small_batches(batches):
            x, z = _views(batch, words)
            ids = batch.column(0).to_pylist()
            key = [xxhash.xxh64_intdigest(f"{d}:".encode() + a.tobytes() + b.tobytes()) >> 1 for d, a, b in zip(ids, x, z, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), _lists(x), _lists(z)], ["key", "x", "z"])

    return _known(docs).mapInArrow(run, "key long, x array<double>, z array<double>")


def surest_rows(pool: DataFrame, models: list, taken: list[set[int]]) -> dict[tuple[int, float], tuple[np.ndarray, np.ndarray]]:
    """For each giver (0: text, 1: page) and label: the features of the ``HANDED`` rows of the whole pool that it is surest of, of those that are ``SURE`` and weren't handed to the taker before.

    Each task names its own surest, and the surest of those are taken, ties by the rows' keys.
    """
    before = [frozenset(t) for t in taken]

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            key = batch.column(0).to_numpy()
            x, z = (np.stack(batch.column(i).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 1)) for i in (1, 2))
            for giver, own in ((0, x), (1, z)):
                p = models[giver].probability(own) if batch.num_rows else np.zeros(0)
                fresh = np.array([k not in before[1 - giver] for k in key.tolist()], bool)
                for label, sure in ((1.0, p), (0.0, 1 - p)):
                    good = np.flatnonzero((sure >= SURE) & fresh)
                    best = good[np.lexsort((key[good], -sure[good]))][:HANDED]
                    held += [(giver, label, float(sure[i]), int(key[i]), x[i].tolist(), z[i].tolist()) for i in best]
            if len(held) > 16 * HANDED:
                held = _topmost(held)
        kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        names = ["giver", "label", "sure", "key", "x", "z"]
        top = _topmost(held)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*top, strict=True) if top else [[]] * 6, kinds, strict=True)], names)

    named = written(pool.mapInArrow(run, "giver int, label double, sure double, key long, x array<double>, z array<double>"), "surest")
    out = {}
    for giver in (0, 1):
        for label in (1.0, 0.0):
            rows = named.where((F.col("giver") == giver) & (F.col("label") == label)).orderBy(F.desc("sure"), "key").limit(HANDED).collect()
            taken[1 - giver] |= {r["key"] for r in rows}
            out[giver, label] = np.array([r["x"] for r in rows]), np.array([r["z"] for r in rows])
    return out


def _topmost(held: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for kind in sorted({r[:2] for r in held}):
        out += sorted((r for r in held if r[:2] == kind), key=lambda r: (-r[2], r[3]))[:HANDED]
    return out


def fit_quality(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of ``labels`` (``doc_id, quality``) and on what the views teach each other over all rows of ``docs``.

    A document labelled more than once has the mean, rounded; labels that are null, or of no document, don't count. Without rows of
    both classes in either half every document scores 1.
    """
    x, b, z, y = _labelled(docs, labels)
    half = np.arange(len(y)) % 2 == 0
    if len(set(y[half])) < 2 or len(set(y[~half])) < 2:
        return Model(None, None)
    own = [b[i] for i in np.flatnonzero(half)]
    words = word_weights(own, y[half])
    score = np.array([word_score(words, r) for r in b])
    score[half] = crossed_scores(own, y[half])
    views = [np.concatenate([np.array(x), score[:, None]], 1), np.array(z)]
    pool = written(_pool(docs, words), "views")
    taken: list[set[int]] = [set(), set()]
    text, page = co_train(views, y, lambda models: surest_rows(pool, models, taken))
    p, q = text.probability(views[0][~half]), page.probability(views[1][~half])
    model = Model(text, page, _stacked(p, q, y[~half]), 0.5, words)
    good = model.scores(views[0][~half], views[1][~half])[2][y[~half] == 1]
    model.keep = min(0.5, float(np.quantile(good, LOSS, method="lower")))
    return model


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, p_text, p_page, score, kept`` for each row of ``docs``, in one pass. A null text is an empty one; missing or null page data count as unknown."""

    def run(batches):
        for batch in small_batches(batches):
            p, q, s = model.scores(*_views(batch, model.words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(q), pa.array(s), pa.array(s >= model.keep)], ["doc_id", "p_text", "p_page", "score", "kept"])

    return texts(_known(docs), "lang", "source", "n_chars").mapInArrow(run, "doc_id long, p_text double, p_page double, score double, kept boolean")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` keeps, with all their columns, whatever their names and types; decided and filtered in the same pass."""
    have = set(docs.columns)
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", *((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))

    def run(batches):
        for batch in small_batches(batches):
            yield batch.filter(pa.array(model.scores(*_views(batch, model.words))[2] >= model.keep))

    return rows.mapInArrow(run, rows.schema).select("row.*")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on ``labels`` and score every document: see ``fit_quality`` and ``score_quality``."""
    return score_quality(docs, fit_quality(docs, labels))
