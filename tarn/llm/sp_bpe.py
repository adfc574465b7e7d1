"""Byte-level BPE through a sentencepiece model that is serialised straight from a vocabulary of ranks.

Each byte string of the vocabulary becomes a piece, its bytes mapped to printable characters, with the negative rank as its
score; the normaliser is the identity and nothing is added or escaped. sentencepiece then merges the adjacent pair of the best
score first, leftmost among equals, which is the order of ranks. Text is cut into pre-tokens first, and each pre-token is
encoded by itself; one that is in the vocabulary as it is gets its own rank. Decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm import tokens
from tarn.llm.common import small_batches, texts

#: Field numbers and values of the public sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, BPE = 1, 2, 2


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a serialised message: bytes, integers and 32-bit floats."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """The model: pieces by rank, which must run from 0 without gaps, then one for unknown characters, which never occurs."""
    chars = tokens.byte_chars()
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    out = [
        _field(PIECES, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, NORMAL)) for rank, token in enumerate(ordered)
    ]
    out.append(_field(PIECES, _field(1, b"<unk>") + _field(2, float(-len(ordered))) + _field(3, UNKNOWN)))
    out.append(_field(TRAINER, _field(3, BPE) + _field(4, len(ordered) + 1)))
    out.append(_field(NORMALIZER, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class RankEncoder(tokens.WordEncoder):
    """Encodes by the serialised model; ``decode`` is the inverse mapping."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        self.ranks = read_ranks(path)
        if len(self.ranks) >= 1 << 16:
            raise ValueError("ids over 65535 don't fit two bytes")
        self.processor = SentencePieceProcessor(model_proto=serialised_model(self.ranks))
        byte = {c: b for b, c in enumerate(tokens.byte_chars())}
        self.bytes_of = [bytes(byte[c] for c in self.processor.id_to_piece(i)) for i in range(len(self.ranks))]

    def piece_ids(self, mapped: str, raw: str) -> list[int]:
        own = self.ranks.get(raw.encode())
        return self.processor.encode(mapped) if own is None else [own]

    def whole_ids(self, text: str) -> list[int]:
        return [i for piece in self.pieces(text) for i in self.piece_ids(self.spelled(piece), piece)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("H", ids)))


@lru_cache(maxsize=4)
def rank_encoder(path: str) -> RankEncoder:
    """One for each worker process, so that its words last from task to task."""
    return RankEncoder(path)


def encoded(docs: DataFrame, *, vocabulary: str) -> DataFrame:
    """Encode every whole text (null: empty), then decode its ids: ``doc_id, n_tokens, ids`` (u16 little-endian)``, ids_sha256`` (of the ids as u32)``, decoded`` (bytes)``, decoded_sha256``.

    An empty text has no ids and decodes to nothing. Repeated rows and null ids are kept as they are; other columns of ``docs``
    are not used. One pass over the table, no shuffle.
    """
    names = ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"]

    def run(batches):
        encoder = rank_encoder(vocabulary)
        for batch in small_batches(batches):
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            back = [encoder.decode(i) for i in ids]
            columns = [
                batch.column(0),
                pa.array([len(i) // 2 for i in ids], pa.int64()),
                pa.array(ids, pa.binary()),
                pa.array([hashlib.sha256(np.frombuffer(i, "<u2").astype("<u4")).hexdigest() for i in ids], pa.string()),
                pa.array(back, pa.binary()),
                pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded binary, decoded_sha256 string")
