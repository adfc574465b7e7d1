"""Every stage of the pipeline against a plain version in Python, on its own input."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_documents import by_hand, truth
from tokenizers import Tokenizer

import corpus_pipeline
from tarn.llm import cotraining, pii
from tarn.llm.common import written
from tarn.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"


def scored(model, r):
    x = [*cotraining.text_features(r.text or ""), cotraining.word_score(model.words, cotraining.word_buckets(r.text or ""))]
    p, q = by_hand(model.text, x), by_hand(model.page, cotraining.page_features(r.lang, r.source, r.n_chars))
    logit = lambda v: math.log(min(max(v, 1e-6), 1 - 1e-6) / (1 - min(max(v, 1e-6), 1 - 1e-6)))
    a, b, c = model.weights
    return 1 / (1 + math.exp(-(a * logit(p) + b * logit(q) + c)))


def redacted(text, spans):
    out, at = [], 0
    for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


@pytest.mark.parametrize("extra", [False, True])
def test_stages_against_plain_python(spark, extra):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if extra:
        docs = docs.withColumn("offset", F.lit("x")).withColumn("rows", F.lit(1)).withColumn("row", F.lit(2)).withColumn("node", F.lit("n"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "near_dedup", "pii", "packing"]

    def run(name, before):
        after = written(stages[name](spark, before, SF), name)
        if name != "packing":
            assert after.columns == docs.columns
        return after, before.collect(), after.collect()

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good, given, got = run("quality_classifier", docs)
    model = cotraining.fit_quality(docs, labels)
    near_edge = {r.doc_id for r in given if abs(scored(model, r) - model.keep) < 1e-9}
    assert {r.doc_id for r in got} ^ {r.doc_id for r in given if scored(model, r) >= model.keep} <= near_edge and len(got) > 0.6 * len(given)

    single, given, got = run("exact_dedup", good)
    lowered = {}
    for r in given:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        lowered[key] = max(lowered.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in got) == sorted(lowered.values()) and len(got) < len(given)

    apart, given, got = run("near_dedup", single)
    classes = truth(given)
    assert sorted(r.doc_id for r in got) == sorted(set(classes.values())) and len(got) < len(given)

    clean, given, got = run("pii", apart)
    spans = {r.doc_id: r.spans for r in pii.find_pii(apart).collect()}
    texts = {r.doc_id: r for r in got}
    assert len(got) == len(given) and any(spans.values())
    for r in given:
        want = redacted(r.text or "", spans[r.doc_id]) if spans[r.doc_id] else r.text
        assert texts[r.doc_id].text == want and (not spans[r.doc_id] or texts[r.doc_id].n_chars == len(want))

    _, given, got = run("packing", clean)
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    pieces, fill = {}, {}
    for p in sorted(got, key=lambda p: (p.doc_id, p.piece)):
        pieces.setdefault(p.doc_id, []).append(p)
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(pieces) == {r.doc_id for r in given}
    for r in given:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        own = pieces[r.doc_id]
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and sum(p.length for p in own) == len(ids)
        assert (len(own) == 1) == (len(ids) <= 2048) and all(p.length == 2048 for p in own[1:])
        for p in own:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for places in fill.values():
        places.sort()
        assert [a for a, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= 2048
    least = math.ceil(sum(n for places in fill.values() for _, n in places) / 2048)
    assert len(fill) <= least + 2


def test_nothing_goes_in_and_nothing_comes_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_nulls_go_through(spark):
    kept = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "some words that have no id at all in this text here", "en", None, None), (3, "", None, "s", 0)], kept.schema)
    docs = kept.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
    assert docs.where("doc_id is null").count() > 0
