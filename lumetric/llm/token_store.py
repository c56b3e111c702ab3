"""Token ids in directly addressable codes.

A file ("segment") holds the ids of consecutive documents in ascending doc_id
order. Ids are cut into chunks, lowest bits first: level 0 has one chunk for
each id, level k those ids that have set bits beyond level k - 1. A bitmap on each
level but the last tells which ids go on, and a rank directory (ones before
every 512th bit) says where on the next level. So id i is found by one rank per
level, without decoding anything before it.

    segment  = MAGIC, counts of ids, documents, levels (u64 each),
               offsets of the documents (u64 each, one more than documents),
               then for each level: width u8, number of chunks u64,
               chunks (packed to whole bytes: u8 or u16), bitmap bytes,
               directory (u32 each)

Segments travel as rows of a Parquet table, so any store that Spark writes holds
them, commits are atomic, and a lost executor costs a repeated task. A segment
ends after SEGMENT_IDS ids, at the end of a document.

Encoding runs in the tokenizers library, before anything is shuffled: only packed
ids travel (2 bytes each where the vocabulary allows). Texts are split by the
pattern as the library would (the same places for every code point), and the
library encodes each piece that a bounded memo doesn't hold; a text that
contains an added token (such as an end-of-text marker) goes to the library whole.

Parts are ranges of doc_id. Their bounds come from a scan of doc_id alone; a
doc_id (or the rows without one) that holds several parts' worth of rows is dealt
over as many parts by the rows' places in their input.

Defined results
    null text       encoded as the empty text: the end id alone
    very long text  whole text; a document lies within one segment
    repeated rows   each is a document of its own; rows of one doc_id are
                    neighbours, ordered by their ids within a part
    null doc_id     first
    empty table     no segments, empty result
    other columns   ignored
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import Memo, pack, sliced
from .common import read, shared_table, take

VOCABULARY, END_ID = "byte_bpe_50k.json", 0
SEGMENT_IDS = 1_000_000
#: Bytes after which the memo of pieces starts again.
MEMO_BYTES = 176_000_000
MAGIC, BLOCK = b"DAC1", 512
#: Bits of the levels; the last level takes what is left.
WIDTHS = (8, 8, 16)
OWNER = "token_store"


# ---- the file format -------------------------------------------------------


class Level:
    def __init__(self, width: int, chunks: np.ndarray, bits: bytes, directory: np.ndarray) -> None:
        self.width, self.chunks, self.bits, self.directory = width, chunks, np.frombuffer(bits, np.uint8), directory

    def goes_on(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place: the directory, then the bits since its entry."""
        out = self.directory[at // BLOCK].astype(np.int64)
        start = at // BLOCK * (BLOCK // 8)
        whole = at >> 3
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)]) if len(at) > 64 else None
        if ones is not None:
            out += ones[whole] - ones[start]
        else:
            out += np.array([int(np.bitwise_count(self.bits[s:e]).sum()) for s, e in zip(start, whole, strict=True)], dtype=np.int64)
        rest = (at & 7) > 0
        low = self.bits[np.where(rest, whole, 0)] & ((1 << (at & 7)) - 1).astype(np.uint8) if len(self.bits) else np.zeros(len(at), np.uint8)
        return out + np.where(rest, np.bitwise_count(low), 0)


def encode_segment(ids: np.ndarray, offsets: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """ids: unsigned, under 2^32. offsets: of the documents, from 0 to len(ids)."""
    left, out, levels = ids.astype(np.uint64), [], 0
    for k, width in enumerate(widths):
        rest = left >> np.uint64(width)
        on = rest > 0
        if k == len(widths) - 1:
            on[:] = False
        chunks = (left & np.uint64((1 << width) - 1)).astype("<u2" if width > 8 else "<u1")
        bits = np.packbits(on, bitorder="little")
        ones = np.r_[0, np.cumsum(on, dtype=np.int64)][: len(on) + 1 : BLOCK].astype("<u4")
        out += [struct.pack("<BQ", width, len(chunks)), chunks.tobytes(), bits.tobytes(), ones.tobytes()]
        levels += 1
        left = rest[on]
        if not len(left):
            break
    head = MAGIC + struct.pack("<QQQ", len(ids), len(offsets) - 1, levels)
    return b"".join([head, offsets.astype("<u8").tobytes(), *out])


class Segment:
    """A read segment: get() is random access, span() a range of ids."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a segment")
        self.n, docs, levels = struct.unpack_from("<QQQ", data, 4)
        at = 28
        self.offsets = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.levels: list[Level] = []
        for _ in range(levels):
            width, n = struct.unpack_from("<BQ", data, at)
            at += 9
            kind = "<u2" if width > 8 else "<u1"
            chunks = np.frombuffer(data, kind, n, at)
            at += n * (2 if width > 8 else 1)
            size = (n + 7) // 8
            bits = data[at : at + size]
            at += size
            entries = n // BLOCK + 1
            self.levels.append(Level(width, chunks, bits, np.frombuffer(data, "<u4", entries, at)))
            at += 4 * entries

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, in the places' order."""
        out, shift = np.zeros(len(places), np.uint64), 0
        into, at = np.arange(len(places)), np.asarray(places, np.int64)
        for level in self.levels:
            if not len(at):
                break
            out[into] |= level.chunks[at].astype(np.uint64) << np.uint64(shift)
            on = level.goes_on(at)
            into, at = into[on], level.rank(at[on])
            shift += level.width
        return out.astype("<u4")

    def get(self, place: int) -> int:
        return int(self.take(np.array([place]))[0])

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids of a range: on every level they stand side by side, from the rank of the first on."""
        out, shift = np.zeros(end - start, np.uint64), 0
        into: np.ndarray | slice = slice(None)
        for level in self.levels:
            if start == end:
                break
            out[into] |= level.chunks[start:end].astype(np.uint64) << np.uint64(shift)
            on = np.flatnonzero(np.unpackbits(level.bits[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 : (start & 7) + end - start])
            into = on if isinstance(into, slice) else into[on]
            start = int(level.rank(np.array([start]))[0])
            end = start + len(on)
            shift += level.width
        return out.astype("<u4")


# ---- writing ---------------------------------------------------------------


class Library:
    """The tokenizers library behind a bounded memo of pieces; one in each worker."""

    _held: dict[int, Library] = {}

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.vocabulary = vocabulary
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo(self.pieces, MEMO_BYTES)

    @classmethod
    def of(cls, vocabulary: str) -> Library:
        if id(vocabulary) not in cls._held:
            cls._held = {id(vocabulary): cls(vocabulary)}
        return cls._held[id(vocabulary)]

    def pieces(self, found: list[str]) -> Iterator[bytes]:
        for at in range(0, len(found), 4096):
            for e in self.tokenizer.encode_batch_fast(found[at : at + 4096], add_special_tokens=False):
                yield pack(e.ids)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def marked(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        """The ids of each text, uint32."""
        return self.memo.text_ids(texts, self.whole, self.marked)


def bounds(docs: DataFrame, parts: int) -> tuple[int, np.ndarray]:
    """Into about so many parts: how many are for rows without a doc_id, and the upper
    ends (ascending, with repeats) of all others but the last."""
    at = F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts))
    total, named, ends = docs.agg(F.count(F.lit(1)), F.count("doc_id"), at).first()
    return -(-(total - named) * parts // max(total, 1)), np.array(ends if named and parts > 1 else [], np.int64)


def parts_of(doc_ids: np.ndarray, known: np.ndarray, places: np.ndarray, nulls: int, ends: np.ndarray) -> np.ndarray:
    """The part of each row; a doc_id that is the end of several takes turns by the row's place."""
    low, high = np.searchsorted(ends, doc_ids, "left"), np.searchsorted(ends, doc_ids, "right")
    return np.where(known, nulls + low + places % np.maximum(high - low, 1), places % max(nulls, 1))


def write_segments(docs: DataFrame, owner: str = OWNER, path: str | None = None, segment_ids: int = SEGMENT_IDS, end_id: int = END_ID, widths: tuple[int, ...] = WIDTHS, parts: int | None = None) -> DataFrame:
    """Writes the segments to the shared folder; returns their table: part,
    number and first place (within the part), doc_ids, n_ids and data."""
    spark = docs.sparkSession
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    rows = take(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    nulls, ends = bounds(rows.select("doc_id"), parts or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, place = Library.of(vocabulary.value), 0
        for b in sliced(batches, 1):
            doc_ids = b.column(0)
            known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
            part = parts_of(doc_ids.fill_null(0).to_numpy(), known, np.arange(place, place + len(doc_ids)), nulls, ends)
            place += len(doc_ids)
            ids = [x.astype("<u2").tobytes() + b"2" if not len(x) or x.max() < 1 << 16 else x.tobytes() + b"4" for x in library.encode(b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), doc_ids, pa.array(ids, pa.binary())], ["part", "doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = None, 0
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        total = inside = 0

        def segment() -> pa.RecordBatch:
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])]
            data = encode_segment(np.concatenate(ids), offsets, widths)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([inside], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([total], pa.int64()), pa.array([data], pa.binary())],
                ["part", "number", "inside", "doc_ids", "n_ids", "data"],
            )

        for b in sliced(batches):
            for at, name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if names and (at != part or total >= segment_ids):
                    yield segment()
                    names, ids, total, number, inside = [], [], 0, number + 1, inside + total
                if at != part:
                    part, number, inside = at, 0, 0
                packed = x.as_py()
                names.append(name)
                ids.append(np.r_[np.frombuffer(packed, f"<u{packed[-1:].decode()}", (len(packed) - 1) // int(packed[-1:])).astype(np.uint32), np.uint32(end_id)])
                total += len(ids[-1])
        if names:
            yield segment()

    sent = rows.mapInArrow(encoded, "part int, doc_id bigint, ids binary").repartitionById(nulls + len(ends) + 1, "part")
    table = sent.sortWithinPartitions("part", "doc_id", "ids").mapInArrow(run, "part int, number bigint, inside bigint, doc_ids array<bigint>, n_ids bigint, data binary")
    return shared_table(table, owner, "segments")


def with_starts(segments: DataFrame) -> DataFrame:
    """Adds start, the ids of all segments before. A segment knows its place within
    its part; the parts' sums are one row for each partition of the sort, so
    their running total and broadcast have a known size."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("ids_"))
    before = parts.select(F.col("part").alias("part_"), (F.sum("ids_").over(W.orderBy("part")) - F.col("ids_")).alias("before_"))
    placed = segments.join(F.broadcast(before), F.col("part") == F.col("part_"))
    return placed.select("part", "number", "doc_ids", "n_ids", "data", (F.col("before_") + F.col("inside")).alias("start"))


def read_documents(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (and ids) of every document, read by
    address from the segments."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for names, start, data in zip(b.column(0), b.column(1), b.column(2), strict=True):
                seg, begin = Segment(data.as_py()), start.as_py()
                ends = seg.offsets
                flat = seg.span(0, seg.n)
                raw, at = memoryview(flat.tobytes()), (4 * ends).tolist()
                out = [
                    names.values, pa.array(begin + ends[:-1]), pa.array(np.diff(ends)),
                    pa.array([zlib.crc32(raw[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                ]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return segments.select("doc_ids", "start", "data").mapInArrow(run, schema)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = write_segments(read(spark, sf_dir, "documents"))
    return read_documents(with_starts(segments)).select("doc_id", "start", "n_tokens", "ids_crc32")
