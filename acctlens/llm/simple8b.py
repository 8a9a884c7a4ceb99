"""Token files in Simple-8b word-aligned coding.

``encode_ids`` packs ids into 64-bit words: a 4-bit selector and 60 bits that hold 60 one-bit ids
down to one 60-bit id.  Selector 15 is the escape: its payload points into a list of full 64-bit
ids.  No word crosses a block of ``BLOCK`` ids, and the first word of each block is stored, so
blocks decode on their own and all at once with numpy.

``write_token_files`` tokenizes a table and writes it in ascending id order as a table of
self-contained segments (``payload`` below) in Parquet containers, so any store that Spark can
write works; ``read_token_files`` reads such a folder back.

Payload: magic ``S8B1``; document count, id count, word count, block count, escape count (int64,
little-endian); then document lengths and first words of blocks (int64), words and escapes
(uint64).

Order: ascending id, null ids first, equal ids by text hash; equal rows are interchangeable.
Null and empty texts give only the end id.  An empty table gives a folder without segments, which
reads back as no rows.  Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acctlens.llm.piece_encoder import SLICE_BYTES, encoder_for
from acctlens.llm.text import column, gather_runs, slices
from acctlens.session import checkpoint_dir

BLOCK = 1024
# Ids per word and bits per id, by selector; 15 is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60, 60])
ESCAPE, ONE = 15, 13
_MAGIC = b"S8B1"
SEGMENT_IDS = 1 << 18
_WIDTHS = np.maximum(1, np.ceil(np.log2(np.arange(1 << 16) + 1.0))).astype(np.uint8)


def _bit_widths(ids: np.ndarray) -> np.ndarray:
    widths = _WIDTHS[(ids & np.uint64(0xFFFF)).astype(np.intp)]
    for shift in (16, 32, 48):
        high = ids >> np.uint64(shift)
        if not high.any():
            break
        widths = np.where(high > 0, _WIDTHS[(high & np.uint64(0xFFFF)).astype(np.intp)] + np.uint8(shift), widths)
    return widths


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    widths = _bit_widths(ids)
    escaped = widths > 60
    escapes = ids[escaped]
    ids = np.where(escaped, np.cumsum(escaped).astype(np.uint64) - np.uint64(1), ids)
    left = np.arange(n, 0, -1)
    room = np.minimum(np.minimum(BLOCK - np.arange(n) % BLOCK, left), 255).astype(np.uint8)
    chosen = np.full(n, ONE, np.uint8)
    widest, span = widths, 1                               # of the next ``span`` ids
    for s in range(ONE - 1, -1, -1):                      # ever more ids of ever fewer bits
        c, half = int(COUNTS[s]), span
        if c > n:
            break
        while span < c:                                     # two overlapping windows make a wider one
            step = min(half, c - span)
            widest = np.maximum(widest[:-step], widest[step:])
            span += step
        fits = (widest <= BITS[s]) & (room[: n - c + 1] >= c)
        if not fits.any():
            break
        np.putmask(chosen[: n - c + 1], fits, s)
    chosen[escaped] = ESCAPE
    # follow the chosen words through all blocks side by side
    opens = np.zeros(n, bool)
    at = np.arange(0, n, BLOCK)
    ends = np.minimum(at + BLOCK, n)
    while len(at):
        opens[at] = True
        at = at + COUNTS[chosen[at]]
        on = at < ends
        at, ends = at[on], ends[on]
    first = np.flatnonzero(opens)
    sel = chosen[first]
    out = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        shifts = np.arange(int(COUNTS[s]), dtype=np.uint64) * np.uint64(BITS[s])
        out[rows] |= np.bitwise_or.reduce(ids[first[rows][:, None] + np.arange(int(COUNTS[s]))] << shifts, axis=1)
    return out, np.searchsorted(first, np.arange(0, n, BLOCK)), escapes


def decode_ids(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of any run of whole blocks."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[sel]
    at = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s >= ONE:
            got = words[rows] & np.uint64((1 << 60) - 1)
            out[at[rows]] = escapes[got.astype(np.int64)] if s == ESCAPE else got
            continue
        c, b = int(COUNTS[s]), int(BITS[s])
        shifts = np.arange(c, dtype=np.uint64) * np.uint64(b)
        out[at[rows][:, None] + np.arange(c)] = (words[rows][:, None] >> shifts) & np.uint64((1 << b) - 1)
    return out


def decode_block(words: np.ndarray, block_words: np.ndarray, escapes: np.ndarray, block: int) -> np.ndarray:
    """One block alone, found through the offsets."""
    end = block_words[block + 1] if block + 1 < len(block_words) else len(words)
    return decode_ids(words[block_words[block]: end], escapes)


def pack_segment(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    words, blocks, escapes = encode_ids(ids)
    head = np.array([len(lengths), len(ids), len(words), len(blocks), len(escapes)], "<i8")
    return b"".join([_MAGIC, head.tobytes(), np.asarray(lengths, "<i8").tobytes(), blocks.astype("<i8").tobytes(),
                     words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def unpack_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths by document)."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a Simple-8b segment")
    docs, n, words, blocks, escapes = np.frombuffer(payload, "<i8", 5, 4)
    at = 44
    lengths = np.frombuffer(payload, "<i8", docs, at)
    at += 8 * (docs + blocks)
    ids = decode_ids(np.frombuffer(payload, "<u8", words, at), np.frombuffer(payload, "<u8", escapes, at + 8 * words))
    if len(ids) != n or lengths.sum() != n:
        raise ValueError("damaged Simple-8b segment")
    return ids, lengths


_SEGMENTS = ("part int, segment int, first_id long, n_ids long, doc_ids array<bigint>, payload binary")


def write_token_files(df: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id",
                      text_col: str = "text", end_id: int = 1) -> None:
    """Tokenize ``df`` and write segments, ``end_id`` after every document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seen, k = TaskContext.get().partitionId(), 0, 0
        encoder = encoder_for(tokenizer_path)
        for b in slices(batches, "text", SLICE_BYTES):
            ids, off = encoder.encode(column(b, "text"))
            lens = np.diff(off) + 1
            ends = np.cumsum(lens)
            out = np.empty(int(ends[-1]), np.uint64)
            out[ends - 1] = end_id
            keep = np.ones(len(out), bool)
            keep[ends - 1] = False
            out[keep] = ids
            docs = column(b, "id")
            cut = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], SEGMENT_IDS)[1:]))
            for lo, hi in zip([0, *cut], [*cut, len(lens)]):
                if hi == lo:
                    continue
                a, z = ends[lo] - lens[lo], ends[hi - 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([seen + int(a)], pa.int64()),
                     pa.array([int(z - a)], pa.int64()), pa.array([docs.slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                     pa.array([pack_segment(out[a:z], lens[lo:hi])], pa.binary())],
                    names=["part", "segment", "first_id", "n_ids", "doc_ids", "payload"])
                k += 1
            seen += int(ends[-1])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    (rows.repartitionByRange(F.col("id"), tie).sortWithinPartitions(F.col("id"), tie)
     .mapInArrow(encode, _SEGMENTS).write.mode("overwrite").option("compression", "zstd").parquet(folder))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with ``start``: the ids of all segments before them (parts count in order)."""
    seg = spark.read.schema(_SEGMENTS).parquet(folder)
    parts = seg.groupBy("part").agg(F.sum("n_ids").alias("ids"))          # one row per file
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    return (seg.join(before, "part")
            .select("doc_ids", "payload", (F.col("before") + F.col("first_id")).alias("start")))


def document_ids(segments: DataFrame) -> DataFrame:
    """doc_id, start, ids of every document (the files' own contents)."""

    def decode(batches):
        for b in batches:
            for docs, payload, start in zip(*(column(b, c) for c in ("doc_ids", "payload", "start"))):
                ids, lens = unpack_segment(payload.as_py())
                ends = np.cumsum(lens)
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(start.as_py() + ends - lens, pa.int64()),
                     pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int64)))],
                    names=["doc_id", "start", "ids"])

    return segments.mapInArrow(decode, "doc_id long, start long, ids array<bigint>")


def document_digests(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the segments."""

    def digest(batches):
        for b in batches:
            for docs, payload, start in zip(*(column(b, c) for c in ("doc_ids", "payload", "start"))):
                ids, lens = unpack_segment(payload.as_py())
                raw = memoryview(ids.astype("<u4")).cast("B")
                ends = np.cumsum(lens)
                crc = [zlib.crc32(raw[4 * a: 4 * z]) for a, z in zip((ends - lens).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(start.as_py() + ends - lens, pa.int64()), pa.array(lens, pa.int64()),
                     pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark: SparkSession) -> str:
    """A fresh folder beside the session's checkpoints."""
    return checkpoint_dir(spark).rstrip("/") + f"/tokens-{uuid.uuid4().hex}"
