"""Byte-level BPE through a sentencepiece model built directly from a vocabulary of ranks.

Each token's bytes are mapped to printable characters, one for each byte, and become a piece whose score is its negative
rank; normalisation is the identity. Sentencepiece then merges in the order of the ranks. Pre-tokens (matches of the
pattern) are encoded each by itself; decoding maps ids back to bytes. Parts of a text that the pattern always splits
are encoded once and kept in a dictionary of bounded size. One pass, no shuffle. Null and empty texts have no ids; a
very long text is encoded whole; equal texts have equal ids, repeated rows stay; no documents give no rows. Strings of
special tokens are ordinary text. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sorrel.llm.common import by_batch, documents, pieces
from sorrel.llm.encoding import TextEncoder, byte_characters, kept_encoder


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[k] for k in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field in the wire format of protocol buffers."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; an unknown piece, never used, comes last."""
    char = byte_characters()
    out = [_field(1, _field(1, "".join(char[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, token in enumerate(tokens)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))  # model type BPE, size, id of unknown
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no prefix, spaces neither removed nor escaped
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Codec(TextEncoder):
    """Encodes texts and decodes ids by the ranks at path; pattern: what is encoded by itself."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.decimals = [b"%d" % k for k in range(len(self.tokens))]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.split = regex.compile(pattern).findall
        super().__init__()

    def pre_token_ids(self, names: list[str]) -> list[list[int]]:
        """Ids of each pre-token; many are encoded as one sentence, a character between them that is in no piece."""
        out: list[list[int]] = []
        between = len(self.tokens)  # the id of unknown
        for k in range(0, len(names), 512):
            mapped = [self.mapped(x) for x in names[k : k + 512]]
            ids = np.array(self.model.encode("\u2047".join(mapped)), np.int64)
            cuts = np.flatnonzero(ids == between)
            ids = ids.tolist()
            out += [ids[a:b] for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)]
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.pre_token_ids(words)]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        split = [self.split(p) for p in parts]
        flat = iter(self.encode_words([x for s in split for x in s]))
        return [b"".join([next(flat) for _ in s]) for s in split]

    def in_decimal(self, ids: bytes) -> bytes:
        """Ids given as 32-bit bytes, in decimal, joined by spaces."""
        return b" ".join(map(self.decimals.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids given as little-endian 32-bit bytes."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (little-endian 32-bit bytes) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = kept_encoder(Codec, path, pattern)
        for batch in (x for b in batches for x in pieces(b, 1 << 20)):
            yield {"doc_id": batch.column(0), "ids": own.encode(batch.column(1).to_pylist())}

    return by_batch(documents(docs), work, "doc_id long, ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, with exact: do the decoded bytes equal the text's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = kept_encoder(Codec, path, pattern)
        for batch in (x for b in batches for x in pieces(b, 1 << 20)):
            texts = batch.column(1).to_pylist()
            coded = own.encode(texts)
            back = [own.decode(ids) for ids in coded]
            yield {
                "doc_id": batch.column(0),
                "n_tokens": [len(ids) // 4 for ids in coded],
                "ids_sha256": [hashlib.sha256(own.in_decimal(ids)).hexdigest() for ids in coded],
                "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back],
                "exact": [x == t.encode() for x, t in zip(back, texts, strict=True)],
            }

    return by_batch(documents(docs), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
