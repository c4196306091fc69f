"""Byte-level BPE: a rank vocabulary served by a sentencepiece BPE model.

The model is serialised straight from the ranks: each vocabulary entry becomes a piece in which byte b is
the character U+0100+b, scored by its negative rank, under identity normalisation. Its merges then pick the
lowest rank first and the leftmost of equal ones, as the rank files mean. A pre-token that is itself an entry
takes that entry's id at once. Decoding is the inverse mapping of ids to bytes.

Null texts encode as empty ones: no ids, no bytes. A null id list decodes to null; an id outside the
vocabulary raises ValueError. Whole texts are encoded, whatever their length; repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import add_from_text
from millrace.llm.pieces import PieceTable, flattened

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

_BYTE_CHARS = {b: chr(0x100 + b) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one base64 token and its rank in each line."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: a varint, a 32-bit float, or length-delimited bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def mapped(token: bytes) -> str:
    return token.decode("latin-1").translate(_BYTE_CHARS)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids follow the order of the ranks; the unknown piece comes last."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, mapped(token).encode()) + _field(2, -float(rank)) + _field(3, normal))
        for token, rank in sorted(ranks.items(), key=lambda x: x[1])
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(pieces) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*pieces, _field(2, trainer), _field(3, normalizer)])


class Encoder:
    """Encodes text by pre-tokens; keeps the ids of those it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks = ranks
        self.ids_of_pieces = sorted(ranks.values())
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.pretokens = regex.compile(pattern).findall
        self.table = PieceTable(lambda tokens: flattened(self.encode_pretokens(tokens)))

    def encode_pretokens(self, tokens: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(tokens)
        rest = []
        for i, token in enumerate(tokens):
            data = token.encode()
            if (rank := self.ranks.get(data)) is not None:
                out[i] = [rank]
            else:
                rest.append((i, mapped(data)))
        if rest:
            for (i, _), pieces in zip(rest, self.model.encode([m for _, m in rest], out_type=int, num_threads=1), strict=True):
                out[i] = [self.ids_of_pieces[p] for p in pieces]
        return out

    def encode(self, texts: list[str]) -> pa.ListArray:
        tokens: list[str] = []
        ends = [0]
        for text in texts:
            tokens += self.pretokens(text)
            ends.append(len(tokens))
        return self.table.joined(self.table.numbered(tokens), np.array(ends))


class Decoder:
    """Ids to bytes, by one gather over the table of pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        pieces: list[bytes | None] = [None] * size
        for token, rank in ranks.items():
            pieces[rank] = token
        self.pieces = pa.array(pieces, pa.large_binary())

    def decode(self, ids: pa.ListArray) -> pa.Array:
        flat = ids.flatten()
        if len(flat) and not 0 <= pa.compute.min(flat).as_py() <= pa.compute.max(flat).as_py() < len(self.pieces):
            raise ValueError("an id is outside the vocabulary")
        found = self.pieces.take(flat)
        if found.null_count:
            raise ValueError("an id is outside the vocabulary")
        ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, found.offset * 8)
        data = memoryview(found.buffers()[2] or b"")
        counts = pa.compute.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = ends[np.concatenate(([0], np.cumsum(counts)))] if len(ends) else np.zeros(len(ids) + 1, np.int64)
        valid = ids.is_valid().to_pylist()
        return pa.array([bytes(data[a:b]) if ok else None for a, b, ok in zip(cuts[:-1].tolist(), cuts[1:].tolist(), valid, strict=True)], pa.binary())


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(path), pattern)
    return _ENCODERS[key]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", keep_text: bool = True) -> DataFrame:
    """`df` with an array<int> column `ids` of each text's token ids; `path` is read on every executor."""

    def start():
        encoder = _encoder(path, pattern)
        return lambda column: [encoder.encode(column.fill_null("").to_pylist())]

    return add_from_text(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType(), False))], start, keep_text)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", data: str = "decoded", keep_text: bool = True) -> DataFrame:
    """`df` with each text's ids and the bytes that these ids decode to, in one pass."""

    def start():
        import pyarrow.compute  # noqa: F401

        encoder, decoder = _encoder(path, pattern), Decoder(read_ranks(path))

        def work(column):
            coded = encoder.encode(column.fill_null("").to_pylist())
            return [coded, decoder.decode(coded)]

        return work

    return add_from_text(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(data, T.BinaryType())], start, keep_text)


def decode(df: DataFrame, path: str, ids: str = "token_ids", data: str = "decoded") -> DataFrame:
    """`df` with a binary column `data`: the bytes of each row's ids."""

    def start():
        import pyarrow.compute  # noqa: F401

        decoder = Decoder(read_ranks(path))
        return lambda column: [decoder.decode(column)]

    return add_from_text(df, ids, [T.StructField(data, T.BinaryType())], start)
