"""Small numpy / Arrow helpers that run inside tasks: gathers over ragged rows, word shingles,
and bounded work units out of a stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the concatenated runs ``[start, start + length)``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.arange(total)
    out += np.repeat(starts - (ends - lengths), lengths)
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column as Python strings; null counts as the empty text."""
    return [t or "" for t in column(batch, name).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``max_bytes`` of column ``name`` (one row at least)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        c = column(b, name)
        if c.nbytes <= max_bytes:
            yield b
            continue
        lens = np.asarray(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False),
                          dtype=np.int64)
        at = 0
        ends = np.cumsum(lens)
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            n = max(1, int(np.searchsorted(ends, done + max_bytes, side="right")) - at)
            yield b.slice(at, n)
            at += n
    pa.default_memory_pool().release_unused()               # the worker lives on


def words(text: str) -> list[bytes]:
    """Words of the A-Z-lower-cased text: maximal runs without space, tab, LF, VT, FF or CR, as
    UTF-8 (``bytes.lower`` and ``bytes.split`` act on exactly these ASCII characters)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(ws: list[bytes], k: int, seed: int) -> np.ndarray:
    """Unsigned XXH64 of each run of ``k`` words joined by one space, repeats included; with
    fewer words, of the whole sequence; without words, none."""
    if not ws:
        return np.empty(0, np.uint64)
    joined = b" ".join(ws)
    h = xxhash.xxh64_intdigest
    if len(ws) <= k:
        return np.array([h(joined, seed)], np.uint64)
    lens = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(ws) - k + 1].tolist()
    return np.fromiter([h(joined[a:b], seed) for a, b in zip(starts, ends[k - 1:].tolist())],
                       np.uint64, len(starts))
