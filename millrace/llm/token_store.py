"""Token ids in segment files with Elias-Fano document boundaries.

A segment is one binary image: a header, the documents' ids, the Elias-Fano sequence of the documents' ends in
the concatenated id array, select samples, and that id array in 16 or 32 bits. The sequence keeps l low bits of
each end packed and the rest in unary; `Segment.end(i)` selects the i-th one bit from a sample every SAMPLE
documents and a popcount scan, so an offset is found without a table of 64-bit offsets.

`write` encodes the documents, sorts their ids by document (null ids as the least; equal ones by text hash) and hands
the images to Spark's own writer, one row (part, segment, counts, image) each, under a folder that all executors
share. So a retried or duplicated task leaves nothing behind, and any store that Spark reaches will do. `read`
streams documents back from the images; starts are prefix sums over the segments' id counts.

Null texts are empty: they hold the end id only. Repeated rows and ids each keep a place of their own. An empty
table gives an empty store. Other columns, whatever their names, are not read. Texts are encoded whole.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import shared_dir, slices
from millrace.llm.pieces import PieceTable, flattened
from millrace.llm.sharding import LEAST, ranks

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Ids in a segment before it is closed.
SEGMENT_IDS = 4_000_000
SAMPLE = 64
#: Bytes of text that are encoded at once.
SLICE = 4 << 20
#: Segments up to which their places are broadcast to the reading tasks.
BROADCAST_SEGMENTS = 50_000

_MAGIC = b"MRTS"
_HEADER = struct.Struct("<4sHBBQQQ")  # magic, version, bytes an id, low bits, documents, ids, words of the upper bits


def _pack(values: np.ndarray, bits: int) -> bytes:
    """The low `bits` of each value, end to end, least significant first."""
    if not bits:
        return b""
    shifts = np.arange(bits, dtype=np.uint64)
    return np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()


def build(doc_ids: np.ndarray, id_nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment's image; `id_nulls` marks documents without an id."""
    ends, total, n = np.cumsum(counts, dtype=np.uint64), int(ids.size), len(counts)
    low = max(0, int(np.log2(total / n))) if n and total > n else 0
    highs = (ends >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros((int(highs[-1]) // 64 + 1) * 64 if n else 0, np.uint8)
    upper[highs] = 1
    width = 2 if not total or int(ids.max()) < 1 << 16 else 4
    lows = b"".join(_pack(ends[i : i + 65536], low) for i in range(0, n, 65536))  # 65536 values fill whole bytes
    return b"".join([
        _HEADER.pack(_MAGIC, 1, width, low, n, total, len(upper) // 64),
        doc_ids.astype("<i8").tobytes(), np.packbits(id_nulls.astype(np.uint8), bitorder="little").tobytes(),
        lows, np.packbits(upper, bitorder="little").tobytes(), highs[::SAMPLE].astype("<u4" if len(upper) < 1 << 32 else "<u8").tobytes(),
        ids.astype("<u2" if width == 2 else "<u4").tobytes(),
    ])


class Segment:
    """Reads an image."""

    def __init__(self, image: bytes | memoryview):
        view = memoryview(image)
        magic, version, width, self.low, self.n, self.total, words = _HEADER.unpack_from(view)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a token segment")
        at = _HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(view, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids = take("<i8", self.n)
        self.id_nulls = np.unpackbits(take("u1", -(-self.n // 8)), count=self.n, bitorder="little").astype(bool)
        self.lows = take("u1", -(-self.n * self.low // 8))
        self.upper = take("<u8", words)
        self.samples = take("<u4" if words * 64 < 1 << 32 else "<u8", -(-self.n // SAMPLE))
        self.ids = take("<u2" if width == 2 else "<u4", self.total)

    def _low(self, i: int) -> int:
        first, last = i * self.low, (i + 1) * self.low
        data = int.from_bytes(self.lows[first // 8 : -(-last // 8)].tobytes(), "little")
        return data >> first % 8 & (1 << self.low) - 1

    def end(self, i: int) -> int:
        """Where document i ends in the id array: the i-th one bit of the upper bits, joined to the low bits."""
        at = int(self.samples[i // SAMPLE])
        left, word = i % SAMPLE, at // 64
        bits = int(self.upper[word]) >> at % 64 << at % 64
        while (ones := bits.bit_count()) <= left:
            left -= ones
            word += 1
            bits = int(self.upper[word])
        for _ in range(left):
            bits &= bits - 1
        place = word * 64 + (bits & -bits).bit_length() - 1
        return place - i << self.low | self._low(i)

    def bounds(self, i: int) -> tuple[int, int]:
        return self.end(i - 1) if i else 0, self.end(i)

    def ends(self) -> np.ndarray:
        """Every document's end, by one scan."""
        places = np.flatnonzero(np.unpackbits(self.upper.view(np.uint8), bitorder="little"))
        bits = np.unpackbits(self.lows, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
        lows = bits @ (np.int64(1) << np.arange(self.low, dtype=np.int64))
        return (places - np.arange(self.n) << self.low) + lows


#: What a tokenizer file must hold for its words to be encoded one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
_MODEL = {"type": "BPE", "dropout": None, "end_of_word_suffix": "</w>", "continuing_subword_prefix": None}


class TextEncoder:
    """Whole texts through the tokenizers library: right for any file."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, texts: pa.Array) -> pa.ListArray:
        ids, lengths = flattened([e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(ids))


class WordEncoder(TextEncoder):
    """Files of the known form, by words.

    No merge, normalisation or pre-token crosses ASCII white space, nor the place between an ASCII letter and an
    ASCII symbol other than an apostrophe, and case does not matter; so the ids of a text are those of its
    lower-cased pieces in turn, and each distinct piece goes to the library once. Texts that hold an added token go
    there whole.
    """

    LETTER_SYMBOL = r"([a-z])([!-&(-/:-@\[-`{-~])"
    #: Words that the library gets in one text.
    JOINED = 2000

    def __init__(self, tokenizer, added: list[str]):
        super().__init__(tokenizer)
        self.added = "|".join(re.escape(x) for x in added)
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.joinable = all(letter + "</w>" in vocabulary for letter in _byte_letters())
        self.table = PieceTable(self.code)

    def code(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of Latin letters alone are one pre-token each, whose last id ends a word; they go to the library joined."""
        plain = [self.joinable and x.isalpha() and max(x) < "\u0100" for x in pieces]
        words = [x for x, p in zip(pieces, plain, strict=True) if p]
        lines = [" ".join(words[i : i + self.JOINED]) for i in range(0, len(words), self.JOINED)]
        ids = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        ends = np.flatnonzero(self.ends_word[flat]) + 1
        if len(ends) != len(words):
            raise ValueError("a word's last id does not end a word")
        if len(words) == len(pieces):
            return flat, np.diff(ends, prepend=0)
        rest = flattened([e.ids for e in self.tokenizer.encode_batch_fast([x for x, p in zip(pieces, plain, strict=True) if not p], add_special_tokens=False)])
        mask = np.array(plain)
        lengths = np.zeros(len(pieces), np.int64)
        lengths[mask], lengths[~mask] = np.diff(ends, prepend=0), rest[1]
        out = np.zeros(int(lengths.sum()), np.int32)
        of_words = np.repeat(mask, lengths)
        out[of_words], out[~of_words] = flat, rest[0]
        return out, lengths

    def encode(self, texts: pa.Array) -> pa.ListArray:
        whole = pa.compute.match_substring_regex(texts, self.added) if self.added else pa.array(np.zeros(len(texts), bool))
        some = pa.compute.any(whole).as_py()
        own = pa.compute.if_else(whole, "", texts) if some else texts
        spaced = pa.compute.replace_substring_regex(pa.compute.ascii_lower(own), self.LETTER_SYMBOL, r"\1 \2")
        words = pa.compute.ascii_split_whitespace(spaced)
        coded = words.flatten().dictionary_encode()
        numbers = self.table.numbered(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        out = self.table.joined(numbers[coded.indices.to_numpy(zero_copy_only=False)], words.offsets.to_numpy() - words.offsets[0].as_py())
        if not some:
            return out
        texts_of = iter(super().encode(texts.filter(whole)).to_pylist())
        return pa.array([next(texts_of) if w else ids for w, ids in zip(whole.to_pylist(), out.to_pylist(), strict=True)], pa.list_(pa.int32()))


def _byte_letters() -> list[str]:
    """The characters by which a byte-level vocabulary writes the bytes: printable ones stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) for b in printable] + [chr(256 + i) for i in range(256 - len(printable))]


def encoder_of(path: str, special_text: bool = False) -> TextEncoder:
    """By words where the file's parts are those that allow it, else by whole texts. special_text: strings of added tokens are ordinary text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_text
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    added = parts.get("added_tokens") or []
    fits = parts.get("normalizer") == _NORMALIZER and parts.get("pre_tokenizer") == _PRE_TOKENIZER and all(parts["model"].get(k) == v for k, v in _MODEL.items())
    if not fits or any(t["normalized"] or not _LETTER_BEFORE_SYMBOL.search(t["content"]) for t in added):
        return TextEncoder(tokenizer)
    return WordEncoder(tokenizer, [t["content"] for t in added])


#: Added tokens that no piece can hold whole, in any case.
_LETTER_BEFORE_SYMBOL = re.compile(r"[A-Za-z][!-&(-/:-@\[-`{-~]")
_ENCODERS: dict[tuple[str, bool], TextEncoder] = {}


def _encoder(path: str, special_text: bool = False) -> TextEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (path, special_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = encoder_of(path, special_text)
    return _ENCODERS[key]


def _coded(path: str, end_id: int, special_text: bool, splits):
    """From rows (doc_id, id, h, text) to (range, doc_id, id, h, width, ids): the ids and the end id of each text, in 16 bits if the vocabulary allows, else in 32."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        encoder, bounds = _encoder(path, special_text), np.array(splits.value, np.int64).reshape(-1, 2)
        width = 2 if max(end_id + 1, encoder.tokenizer.get_vocab_size(with_added_tokens=True)) <= 1 << 16 else 4
        for batch in batches:
            for piece in slices(batch, 3, SLICE):
                if not piece.num_rows:
                    continue
                coded = encoder.encode(piece.column(3).fill_null(""))
                counts = np.diff(coded.offsets.to_numpy().astype(np.int64)) + 1
                ends = np.cumsum(counts)
                ids = np.full(int(ends[-1]), end_id, f"<u{width}")
                mine = np.ones(ids.size, bool)
                mine[ends - 1] = False
                ids[mine] = coded.flatten().to_numpy()
                offsets = (np.concatenate(([0], ends)) * width).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                place = ranks([piece.column(1).to_numpy(), piece.column(2).to_numpy()], bounds)
                columns = [pa.array(place, pa.int32()), *piece.columns[:3], pa.array(np.full(len(ends), width, np.int32)), data]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "doc_id", "id", "h", "width", "ids"])

    return run


def _images(segment_ids: int):
    """From sorted rows (doc_id, width, ids) to images of at least `segment_ids` ids, but for a part's last."""

    def run(batches):
        part, number, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def close():
            doc_ids, nulls, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()), "n_docs": pa.array([len(counts)], pa.int64()),
                "n_ids": pa.array([ids.size], pa.int64()), "image": pa.array([build(doc_ids, nulls, counts, ids)], pa.binary()),
            })

        for batch in batches:
            for piece in slices(batch, 2):
                if not piece.num_rows:
                    continue
                keys, width, data = piece.column(0), piece.column(1)[0].as_py(), piece.column(2)
                offsets = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4)
                ids = np.frombuffer(data.buffers()[2], f"<u{width}", int(offsets[-1] - offsets[0]) // width, int(offsets[0]))
                held.append((keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False), np.diff(offsets).astype(np.int64) // width, ids.astype(np.uint32)))
                size += ids.size
                if size >= segment_ids:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return run


def _bounds(keyed: DataFrame, n: int) -> list[tuple[int, int]]:
    """The least key of each of n ranges of like numbers of rows, but for the first; one key a range is all that the driver gets."""
    ranged = keyed.select("id", "h").repartitionByRange(n, "id", "h")
    least = ranged.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("id", "h")).alias("key")).collect()
    return sorted((r.key.id, r.key.h) for r in least)[1:]


def write(df: DataFrame, tokenizer: str, store: str | None = None, doc_id: str = "doc_id", text: str = "text",
          end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, partitions: int | None = None, special_text: bool = False) -> str:
    """Write `df` as a segment store; returns its folder (a new one in the shared folder if none is given).

    The bounds of the ranges come from the keys alone; texts are then encoded where they are read, and only their ids are
    exchanged, once. special_text: see `encoder_of`.
    """
    spark = df.sparkSession
    store = store or f"{shared_dir(spark).rstrip('/')}/token-store-{uuid.uuid4().hex}"
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.col(doc_id).cast("bigint")
    keyed = df.select(number.alias("doc_id"), F.coalesce(number, F.lit(LEAST)).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    splits = spark.sparkContext.broadcast(_bounds(keyed, n))
    coded = keyed.mapInArrow(_coded(tokenizer, end_id, special_text, splits), "range int, doc_id bigint, id bigint, h bigint, width int, ids binary")
    placed = coded.repartitionById(n, "range").sortWithinPartitions("id", "h").select("doc_id", "width", "ids")
    schema = "part int, segment int, n_docs bigint, n_ids bigint, image binary"
    placed.mapInArrow(_images(segment_ids), schema).write.parquet(store)
    return store


def places(spark: SparkSession, store: str) -> DataFrame:
    """(part, segment, base): the ids before each segment. Only counts are read; a part's segments are few."""
    counts = spark.read.parquet(store).select("part", "segment", "n_ids")
    per_part = counts.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = per_part.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    return counts.select("part", "segment", inner.alias("inner")).join(before, "part").select("part", "segment", (F.col("before") + F.col("inner")).alias("base"))


def _documents(batches):
    for batch in batches:
        for part, number, image in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), strict=True):
            segment = Segment(image.as_buffer())
            ends = segment.ends()
            starts = np.concatenate(([0], ends[:-1]))
            ids = segment.ids
            crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part] * segment.n, pa.int32()), "segment": pa.array([number] * segment.n, pa.int32()),
                "doc_id": pa.array(segment.doc_ids, pa.int64(), mask=segment.id_nulls), "start": pa.array(starts, pa.int64()),
                "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
            })


def read(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    schema = "part int, segment int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    docs = spark.read.parquet(store).select("part", "segment", "image").mapInArrow(_documents, schema)
    base = places(spark, store)
    if spark.read.parquet(store).count() <= BROADCAST_SEGMENTS:
        base = F.broadcast(base)
    return docs.join(base, ["part", "segment"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
