"""Packing documents into fixed-length sequences by shortest-pack-first over the length histogram.

A document longer than ``max_len`` is cut into full pieces and a rest; the rests (at most
``max_len`` lengths) are packed by their histogram: lengths are placed longest first, always into
the shortest open packing pattern, and patterns carry counts, so the packing works on at most
``max_len`` numbers whatever the number of documents.  Patterns are joined back to pieces by
each piece's rank among the pieces of its length.  Ranks come from windows over (length, salt)
with the salts' counts added up; a length has as many salts as its count needs, so one that a third
of all pieces share is split into parts of about ``ROWS_PER_SALT``.

Null and empty texts are documents of the end id alone.  Equal rows are ranked in any order, as
they are interchangeable; equal ids with different texts keep their own pieces.  An empty table
gives no rows.  Columns other than the two named are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acctlens.llm.piece_encoder import SLICE_BYTES, encoder_for
from acctlens.llm.text import column, slices
from acctlens.session import cut_lineage

ROWS_PER_SALT = 1_000


def token_pieces(df: DataFrame, tokenizer_path: str, max_len: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_path)
        for b in slices(batches, "text", SLICE_BYTES):
            ids, off = encoder.encode(column(b, "text"))
            lens = np.diff(off) + 1
            ends = np.cumsum(lens)
            out = np.full(int(ends[-1]), end_id, "<u4")
            keep = np.ones(len(out), bool)
            keep[ends - 1] = False
            out[keep] = ids
            n = -(-lens // max_len)
            doc = np.repeat(np.arange(len(lens)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * max_len
            length = np.minimum(max_len, lens[doc] - start)
            lo = (ends - lens)[doc] + start
            raw = memoryview(out).cast("B")
            crc = [zlib.crc32(raw[4 * a: 4 * z]) for a, z in zip(lo.tolist(), (lo + length).tolist())]
            cols = [column(b, "id").take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()), pa.array(lens[doc], pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(np.append(lo, lo[-1] + length[-1]).astype(np.int32),
                                                     pa.array(out.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, in order of placing) and how often each is used."""
    open_, fills, done = {}, [], []

    def put(pattern: tuple[int, ...], fill: int, n: int) -> None:
        if fill == max_len:
            done.append((pattern, n))
            return
        if fill not in open_:
            open_[fill] = []
            heapq.heappush(fills, fill)
        open_[fill].append((pattern, n))

    for length in sorted(histogram, reverse=True):
        left, grown = histogram[length], []
        while left:
            if not fills or fills[0] + length > max_len:
                grown.append(((length,), length, left))
                break
            fill = fills[0]
            pattern, n = open_[fill].pop()
            if not open_[fill]:
                del open_[fill]
                heapq.heappop(fills)
            take = min(n, left)
            if n > take:
                put(pattern, fill, n - take)
            put((*pattern, length), fill + length, take)
            left -= take
        for g in grown:
            # as many copies of one short length as fit are stacked at once
            pattern, fill, n = g
            per = max_len // length
            if n >= per > 1:
                put((length,) * per, length * per, n // per)
                n, rest = 0, n % per
                if rest:
                    put((length,) * rest, length * rest, 1)
            if n:
                put(pattern, fill, n)
    return done + [p for f in sorted(open_) for p in open_[f]]


def pack(pieces: DataFrame, max_len: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, start, length, ids_crc32, ...; no piece longer than ``max_len``) with
    ``sequence_id`` and ``offset``; the offsets of a sequence have no gaps."""
    cols = pieces.columns
    pieces = cut_lineage(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return pieces.select(*cols, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # slots: of one length, ranks from low up to the next slot's low go to sequences from first on
    slots, first = [], 0
    used = dict.fromkeys(histogram, 0)
    for pattern, n in shortest_pack_first(histogram, max_len):
        offset = 0
        for length in pattern:
            slots.append((length, used[length], first, offset))
            used[length] += n
            offset += length
        first += n
    slots.sort()
    lengths, lows, firsts, offsets = (np.array(x, np.int64) for x in zip(*slots))
    opens = np.searchsorted(lengths, np.arange(max_len + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (column(b, c).to_numpy() for c in ("length", "__rank"))
            slot = np.empty(len(rank), np.int64)
            for v in np.unique(length):
                rows = np.flatnonzero(length == v)
                slot[rows] = opens[v] + np.searchsorted(lows[opens[v]: opens[v + 1]], rank[rows], side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(column(b, c) for c in cols), pa.array(firsts[slot] + rank - lows[slot]), pa.array(offsets[slot])],
                names=[*cols, "sequence_id", "offset"])

    salts = F.array(*(F.lit(1 + histogram.get(n, 0) // ROWS_PER_SALT) for n in range(1, max_len + 1)))
    key = F.xxhash64("doc_id", "start", "ids_crc32")
    salted = pieces.withColumn("__salt", F.pmod(key, F.element_at(salts, F.col("length").cast("int"))))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    order = Window.partitionBy("length").orderBy("__salt")
    before = counts.select("length", "__salt", (F.sum("__n").over(order) - F.col("__n")).alias("__before"))
    row = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = (salted.withColumn("__row", row).join(before, ["length", "__salt"])
              .select(*cols, (F.col("__before") + F.col("__row") - 1).cast("long").alias("__rank")))
    out = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, out)


def sequences(packed: DataFrame, max_len: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids, n_tokens: the packed pieces' ids (``token_pieces(with_ids=True)``), padded
    to ``max_len`` unless their number is a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    seq = packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    pad = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(F.lit(max_len) - n)
    return seq.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), pad)).alias("ids"), n.alias("n_tokens"))


def pack_documents(df: DataFrame, tokenizer_path: str, max_len: int = 2048, id_col: str = "doc_id",
                   text_col: str = "text", end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``df``: one row per piece."""
    return pack(token_pieces(df, tokenizer_path, max_len, id_col, text_col, end_id, with_ids), max_len)
