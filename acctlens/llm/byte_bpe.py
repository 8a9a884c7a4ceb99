"""Byte-level BPE encoding and decoding from a file of ranks.

The merges are rebuilt from the ranks (a token's merge is the pair its bytes end in when only
lower ranks merge), and the tokenizers library encodes Arrow batches with them; each byte goes in
as its byte character.  Every id stands for fixed bytes, so byte offsets are running sums of the
ids' byte lengths, and character offsets follow from the text's UTF-8 lead bytes; a token may
begin or end inside a character, whose offsets then cover that character.  Decoding gathers the
bytes of the ids; text needs a valid end, so split characters are completed across ids and broken
ones at the ends are replaced.

Null and empty texts have no ids and decode to no bytes.  Repeated rows and ids give repeated
rows; an empty table gives none.  Columns other than the two named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctlens.llm.piece_encoder import LEAD_PATTERN, SLICE_BYTES, PieceEncoder, byte_characters
from acctlens.llm.text import column, gather_runs, slices


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last two parts of a token when its bytes merge by lower ranks only."""
    limit, parts = ranks[token], [token[i: i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= limit:
            return None
        parts[at: at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class ByteBpe:
    """A tokenizer built from ranks; one object per Python worker."""

    def __init__(self, path: str, pattern: str = LEAD_PATTERN):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ranks = read_ranks(path)
        chars = byte_characters()
        spell = lambda b: "".join(chars[x] for x in b)
        vocab = {spell(b): r for b, r in ranks.items()}
        merges = [(spell(m[0]), spell(m[1])) for b in sorted(ranks, key=ranks.get) if len(b) > 1
                  for m in [merge_of(b, ranks)] if m]
        tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        if pattern == LEAD_PATTERN:                         # the library's own pattern
            tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        else:
            tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encoder = PieceEncoder(tokenizer)
        byte_of = {c: b for b, c in enumerate(chars)}
        size = max(ranks.values()) + 1
        spelt = [b""] * size
        for token, r in vocab.items():
            spelt[r] = bytes(byte_of[c] for c in token)      # the byte table, reversed
        self.lengths = np.fromiter(map(len, spelt), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelt), np.uint8)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(texts)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows one after another, offsets of the rows in them)."""
        ids = np.asarray(ids, np.int64)
        lens = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lens)])
        return self.bytes[gather_runs(self.starts[ids], lens)], ends[offsets]

    def char_spans(self, ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) characters that each id of ``text`` touches."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[np.asarray(ids, np.int64)])
        starts = ends - self.lengths[np.asarray(ids, np.int64)]
        return char[starts], char[ends - 1] + 1


_BUILT: dict = {}


def byte_bpe(path: str, pattern: str = LEAD_PATTERN) -> ByteBpe:
    if (path, pattern) not in _BUILT:
        _BUILT[path, pattern] = ByteBpe(path, pattern)
    return _BUILT[path, pattern]


def _narrow(df: DataFrame, id_col: str, col: str, kind: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(col).cast(kind).alias(name))


def encode(df: DataFrame, ranks_path: str, pattern: str = LEAD_PATTERN, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, ids, first_char, end_char (arrays of one length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for b in slices(batches, "text", SLICE_BYTES):
            ids, off = bpe.encode(column(b, "text"))
            spans = [bpe.char_spans(ids[a:z], t.as_py() or "") for a, z, t in zip(off, off[1:], column(b, "text"))]
            rows = pa.array(off, pa.int32())
            lists = [np.concatenate([s[k] for s in spans]).astype(np.int32) if spans else np.empty(0, np.int32) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), *(pa.ListArray.from_arrays(rows, pa.array(v)) for v in (ids.astype(np.int32), *lists))],
                names=["doc_id", "ids", "first_char", "end_char"])

    return _narrow(df, id_col, text_col, "string", "text").mapInArrow(
        run, "doc_id long, ids array<int>, first_char array<int>, end_char array<int>")


def decode(df: DataFrame, ranks_path: str, pattern: str = LEAD_PATTERN, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes, text of rows of ids; in the text, bytes that form no character are U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for b in batches:
            rows = column(b, "ids").to_pylist()
            off = np.concatenate([[0], np.cumsum([len(r or ()) for r in rows])]).astype(np.int64)
            raw, ends = bpe.decode(np.fromiter((i for r in rows for i in r or ()), np.int64, int(off[-1])), off)
            out = [raw[a:z].tobytes() for a, z in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(out, pa.binary()), pa.array([o.decode("utf-8", "replace") for o in out], pa.string())],
                names=["doc_id", "bytes", "text"])

    return _narrow(df, id_col, ids_col, "array<int>", "ids").mapInArrow(run, "doc_id long, bytes binary, text string")


def round_trip_digests(df: DataFrame, ranks_path: str, pattern: str = LEAD_PATTERN, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, decode, and digest in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for b in slices(batches, "text", SLICE_BYTES):
            ids, off = bpe.encode(column(b, "text"))
            raw, ends = bpe.decode(ids, off)
            packed = ids.astype("<u4")
            digest = lambda v, at: [hashlib.sha256(v[a:z]).hexdigest() for a, z in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(digest(packed, off), pa.string()),
                 pa.array(digest(raw, ends), pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _narrow(df, id_col, text_col, "string", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
