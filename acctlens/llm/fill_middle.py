"""Fill-in-middle transformation over token boundaries.

A text is cut into tokens (runs of A-Z and a-z, every other code point alone).  The ends of its
tokens, with 0, form a ``BoundarySet``: positions are split by their high 16 bits into containers,
each kept as a sorted array, a bitmap or a list of runs, whichever is smallest, under cumulative
cardinalities.  The k-th boundary is found by a search over these and a local select, so the two
cuts of a text are two selects.  Rank is the reverse.

Cuts and form come from a hash of the seed and the id, so they do not depend on partitioning, and rows of the
same id and text come out alike.  ``restore`` rebuilds the text from output and form alone: a text
that holds a mark stays plain, and no cut can make up a mark across its ends, so each mark stands
once in an output that is not plain.

Null texts count as empty; empty texts are plain.  A null id hashes as the empty text.  Repeated
rows give repeated rows, an empty table none.  Columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctlens.llm.text import column, slices, texts_of

PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20                              # of 100: plain forms, and spm among the others
_BLOCK = 1 << 16
_ARRAY_MAX = 4096                                           # two bytes a value, against 8192 of a bitmap


class BoundarySet:
    """An immutable sorted set of positions."""

    def __init__(self, values: np.ndarray):
        """``values`` ascending and distinct."""
        self.keys, first = np.unique(values >> 16, return_index=True)
        self.ends = np.append(first[1:], len(values))       # cumulative cardinalities
        self.containers = [_container(c) for c in np.split(values & (_BLOCK - 1), first[1:])] if len(values) else []

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.keys) else 0

    def select(self, k: int) -> int:
        """The k-th smallest member, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.ends, k, side="right"))
        kind, body = self.containers[at]
        k -= int(self.ends[at - 1]) if at else 0
        if kind == "array":
            low = int(body[k])
        elif kind == "run":
            starts, sums = body
            r = int(np.searchsorted(sums, k, side="right"))
            low = int(starts[r]) + k - (int(sums[r - 1]) if r else 0)
        else:
            words, sums = body
            w = int(np.searchsorted(sums, k, side="right"))
            bits = np.flatnonzero(np.unpackbits(words[w: w + 1].view(np.uint8), bitorder="little"))
            low = w * 64 + int(bits[k - (int(sums[w - 1]) if w else 0)])
        return (int(self.keys[at]) << 16) + low

    def rank(self, position: int) -> int:
        """Members below ``position``."""
        lo, hi = 0, len(self)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.select(mid) < position else (lo, mid)
        return lo


def _container(low: np.ndarray) -> tuple:
    """(kind, body) of the 16-bit values: the smallest of the three kinds."""
    new = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    if 4 * len(new) < min(2 * len(low), _BLOCK // 8):
        return "run", (low[new].astype(np.uint16), np.append(new[1:], len(low)))
    if len(low) <= _ARRAY_MAX:
        return "array", low.astype(np.uint16)
    words = np.zeros(_BLOCK, np.uint8)
    words[low] = 1
    words = np.packbits(words, bitorder="little").view(np.uint64)
    return "bitmap", (words, np.cumsum(np.bitwise_count(words), dtype=np.int64))


def boundaries(text: str) -> BoundarySet:
    """0 and the end of every token, in code points."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = code | 32
    letter = (folded >= 97) & (folded <= 122)
    cut = np.ones(len(code) + 1, bool)
    cut[1:-1] = ~(letter[1:] & letter[:-1])
    return BoundarySet(np.flatnonzero(cut))


def transform_text(doc_id: int | None, text: str, seed: int = 1) -> tuple:
    """(n tokens, form, prefix code points, middle code points, output)."""
    cuts = boundaries(text)
    n = len(cuts) - 1 if text else 0
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i: i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= PLAIN_FROM or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = sorted(cuts.select(h % (n + 1)) for h in (h1, h2))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row per row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            made = [transform_text(i, t, seed) for i, t in zip(column(b, "doc_id").to_pylist(), texts_of(b, "text"))]
            n, form, prefix, middle, output = zip(*made)
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return (df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given."""
    parts = F.split(output, f"({'|'.join(MARKS)})", -1)     # "", then the three pieces in their order
    piece = lambda i: F.get(parts, F.lit(i))
    return (F.when(form == "psm", F.concat(piece(1), piece(3), piece(2)))
            .when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output))
