import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarn.llm import packing, records, sp_bpe, tokens

TEXTS = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a \n b", "x\n\n\ny  z", "it's we'll 'S  don't", "日本 語 テスト", "é ü x y", "1 22 3a4 $% ^", "tab\t x", "a <|endoftext|> b", "\x00 \x01 z", "😀 😀x", "a\u0085 b", "word, " * 3000, "q" * 5000, "ab. cd?! ef,\"gh\" it's, x-- y'll... é!! ñ** don't. ªb. ǅ, ⅷ. a١. ʰ. ok.\n(a) [b]. %x 5. 5a. a5, #!", "word.' word.'s a-b a- -b a.b. e.g., ...", "ɐ. aɐ, ɐa! \u0301. a\u0301. _a_ a_."]
SCHEMA = "doc_id long, text string, key string, offset int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k", 1) for i, t in enumerate(TEXTS)] + [(100, None, None, None), (None, "no id", None, None), (7, TEXTS[7], "k", 1), (7, "other", "k", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_words_encode_as_the_library_does():
    e = tokens.library_encoder(tokens.vocabulary("byte_bpe_50k.json"))
    for t in TEXTS:
        assert list(array("H", e.encode(t))) == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_random_texts_encode_as_the_libraries_do():
    tiktoken = pytest.importorskip("tiktoken")
    e = tokens.library_encoder(tokens.vocabulary("byte_bpe_50k.json"))
    r = sp_bpe.rank_encoder(tokens.vocabulary("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=r.ranks, special_tokens={})
    rng = np.random.default_rng(11)
    signs = list("abcXYé ñß  \n\t.,;:!?*&%$#)]}\"'-_(1٣ɐ日\u0301😀") + ["the", "'s", "'ll", " of", "...", "!!"]
    for _ in range(3000):
        t = "".join(rng.choice(signs, rng.integers(1, 25)))
        assert list(array("H", e.encode(t))) == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
        assert list(array("H", r.encode(t))) == own.encode_ordinary(t), repr(t)


def test_added_tokens_encode_as_the_library_does_by_default():
    path = tokens.vocabulary("byte_bpe_50k.json")
    encoder, plain = tokens.LibraryEncoder(path), Tokenizer.from_file(path)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|><|endoftext|> é\n b", "a <|endof text|> b"):
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(encoder.encode("a <|endoftext|> b"), "<u2")


def test_words_are_forgotten_not_wrong(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 2)
    monkeypatch.setattr(tokens, "MAX_PARTS", 2)
    e = tokens.LibraryEncoder(tokens.vocabulary("byte_bpe_50k.json"))
    text = "one two three four two one five"
    assert list(array("H", e.encode(text))) == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(e.words) <= 2


def test_serialised_model_matches_ranks_and_round_trips():
    tiktoken = pytest.importorskip("tiktoken")
    e = sp_bpe.rank_encoder(tokens.vocabulary("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    for t in TEXTS:
        assert list(array("H", e.encode(t))) == own.encode_ordinary(t), t
        assert e.decode(e.encode(t)) == t.encode()


def test_op8_rows(spark, docs):
    got = sp_bpe.encoded(docs, vocabulary=tokens.vocabulary("byte_bpe_multi_50k.tiktoken")).collect()
    assert len(got) == docs.count()
    assert all(len(r.ids) == 2 * r.n_tokens for r in got)
    assert sorted(bytes(r.decoded).decode() for r in got) == sorted((r.text or "") for r in docs.collect())
    assert sp_bpe.encoded(docs.limit(0), vocabulary=tokens.vocabulary("byte_bpe_multi_50k.tiktoken")).count() == 0


def test_records_in_order_with_index(spark, docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    vocabulary = tokens.vocabulary("byte_bpe_50k.json")
    got = records.token_records(docs, vocabulary=vocabulary, path=path).orderBy("shard", "before").collect()
    e = tokens.library_encoder(vocabulary)
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    want = sorted((r.doc_id is not None, r.doc_id or 0, r.h, r.text) for r in hashed.collect())
    start = 0
    assert len(got) == len(want)
    for r, (there, doc_id, _, text) in zip(got, want, strict=True):
        ids = list(array("H", e.encode(text))) + [0]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id if there else None, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    index = records.read_index(spark, path).collect()
    files = {int(f.name[5:10]): f for f in (tmp_path / "shards" / "kind=data").glob("part-*")}
    assert len(index) == len(got) and records.read_order(spark, path, seed=3).select("place").distinct().count() == len(got)
    found = []
    for r in index:  # a record alone, by the index
        with files[r.shard].open("rb") as f:
            doc_id, before, ids = records.record_at(f, r.offset, r.n_bytes)
        assert (doc_id or 0, len(ids) // 2) == (r.doc_id, r.n_tokens)
        found.append((r.shard, before, ids))
    assert sorted(found) == [(r.shard, r.before, bytes(r.ids)) for r in got]
    by_length = [(s, records.unframed(d)[1]) for s, f in sorted(files.items()) for _, d in records.scanned(f.read_bytes())]
    assert by_length == [(r.shard, r.before) for r in got]


def test_records_are_read_by_ranges(spark, docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    vocabulary = tokens.vocabulary("byte_bpe_50k.json")
    records.write_records(docs.coalesce(1), path, vocabulary=vocabulary)
    whole = {(r.shard, r.before, r.ids_crc32) for r in records.read_records(spark, path).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        cut = records.read_records(spark, path)
        assert cut.rdd.getNumPartitions() > 20 and {(r.shard, r.before, r.ids_crc32) for r in cut.collect()} == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("ids", [b"", b"\x0a\x0a\x1b\x01", b"\x1b\x02\x0a\x00", bytes(range(256))])
def test_no_record_holds_its_end(ids):
    for doc_id in (None, 0, -1, 10, 27, 1 << 62):
        one = records.framed(doc_id, 2570, ids)
        assert b"\n" not in one and records.unframed(one) == (doc_id, 2570, ids)


def test_broken_record_raises():
    data = bytearray(records.framed(5, 0, b"\x01\x00"))
    data[-7] ^= 1
    with pytest.raises(ValueError):
        records.unframed(bytes(data))
    with pytest.raises(ValueError):
        records.unframed(bytes(data[:-2]))


def test_empty_records(spark, docs):
    assert records.token_records(docs.limit(0), vocabulary=tokens.vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_plan_places_all_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    n = np.clip(rng.lognormal(5, 1, 4000).astype(int), 1, 512)
    h = np.bincount(n, minlength=513)
    made = packing.plan(h, 512)
    assert made.sequences <= np.ceil(n.sum() / 512) * 1.01 + 1
    placed = [[] for _ in range(made.sequences)]
    for length in range(1, 513):
        own = np.flatnonzero(made.length == length)
        first = [*made.first[own], h[length]]
        assert not len(own) or first[0] == 0
        for k, a, b in zip(own, first, first[1:], strict=False):
            for sequence in range(made.base[k], made.base[k] + b - a):
                placed[sequence].append((int(made.offset[k]), length))
    for own in map(sorted, placed):  # gapless from 0, nothing beyond the end
        assert [a for a, _ in own] == [0, *np.cumsum([b for _, b in own])[:-1]] and sum(b for _, b in own) <= 512
    assert sum(b for own in placed for _, b in own) == n.sum()
    wide, rows = packing.slot_bins(made, h)
    for length in range(1, 513):
        for rank in {0, h[length] // 2, h[length] - 1} if h[length] else ():
            found = [r for r in rows if r[0] == length and r[1] == rank // wide[length] and r[2] <= rank < r[3]]
            assert len(found) == 1
    assert len(rows) < 2 * len(made.length)


def test_plan_of_nothing():
    assert packing.plan(np.zeros(9, int), 8).sequences == 0


def test_fitted_weights_are_least_squares():
    h = np.zeros(9, int)
    h[[3, 5, 2, 6]] = [10, 10, 4, 4]
    rows = packing.patterns(np.flatnonzero(h), 8)
    x = packing.fitted(rows, h, steps=3000)
    got = np.zeros(9)
    for r, v in zip(rows, x, strict=True):
        for k in r[r > 0]:
            got[k] += v
    assert np.allclose(got, h, atol=1e-3)


def test_packed_documents(spark, docs):
    vocabulary = tokens.vocabulary("byte_bpe_50k.json")
    got = packing.packed_documents(docs, vocabulary=vocabulary, capacity=64).toPandas()
    e = tokens.library_encoder(vocabulary)
    want = sum(len(e.encode(r.text or "")) // 2 + 1 for r in docs.collect())
    assert got["length"].sum() == want and got["length"].max() <= 64
    for _, one in got.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert list(one["offset"]) == [0, *one["length"].cumsum()[:-1]] and one["length"].sum() <= 64
    whole = got[got.doc_id == 18].sort_values("piece")
    assert list(whole["start"]) == [0, *whole["length"].cumsum()[:-1]]
    assert (whole["length"].iloc[1:] == 64).all()
    assert all(zlib.crc32(np.frombuffer(i, "<u2").astype("<u4")) == c for i, c in zip(got["ids"], got["ids_crc32"], strict=True))
    assert packing.packed_documents(docs.limit(0), vocabulary=vocabulary).count() == 0
