"""Bottom-k sketches of word shingles.

A sketch holds the ``k`` smallest distinct 64-bit shingle hashes, ascending.  The sketch of a union
is the bottom-k of the sketches' union, so sketches merge across parts of a text or groups of
texts in any order.  Of two sketches: resemblance is the share of the k smallest of the union that
lies in both; containment and distinct counts follow from the k-th smallest value.

``sketch_table`` gives one row per row of the input.  Null and empty texts have the empty sketch;
two empty sketches have resemblance 1, an empty and a filled one 0.  Equal texts have equal
sketches; repeated rows give repeated rows, an empty table none.  Columns other than those named
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctlens.llm.text import column, shingle_hashes, slices, texts_of, words
from acctlens.session import cut_lineage

K, WORDS, SEED = 128, 5, 42
_SPACE = 2.0 ** 64


def bottom_k(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    m = 4 * k
    while m < len(hashes):
        low = np.unique(np.partition(hashes, m - 1)[:m])
        if len(low) >= k:
            return low[:k]
        m *= 4
    return np.unique(hashes)[:k]


def merge(sketches: list[np.ndarray], k: int = K) -> np.ndarray:
    return bottom_k(np.concatenate([np.empty(0, np.uint64), *sketches]), k)


def distinct_count(sketch: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact below k, else (k - 1) over the k-th smallest value's share."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * _SPACE / (float(sketch[-1]) + 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    both = merge([a, b], k)
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True).sum()) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of a's shingles that b has, at most 1; 1 for an empty a."""
    if len(a) == 0:
        return 1.0
    union = distinct_count(merge([a, b], k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_count(a, k))


def sketch_text(text: str, k: int = K) -> np.ndarray:
    return bottom_k(shingle_hashes(words(text), WORDS, SEED), k)


def to_hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def from_hex(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def sketch_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, fingerprint (hex, 16 digits a hash), distinct_shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sk = [sketch_text(t, k) for t in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(map(to_hex, sk), pa.string()), pa.array([distinct_count(s, k) for s in sk], pa.float64())],
                names=["doc_id", "fingerprint", "distinct_shingles"])

    return (df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, fingerprint string, distinct_shingles double"))


def merge_by(sketched: DataFrame, key: str, k: int = K) -> DataFrame:
    """key, fingerprint: the sketch of each key's union of texts.  Hashes are ranked in salted parts
    first, each of which passes on k at most, so a hot key's rows never meet in one task."""
    hashes = sketched.select(key, F.explode(F.regexp_extract_all("fingerprint", F.lit("([0-9a-f]{16})"), F.lit(1))).alias("__h"))
    hashes = hashes.distinct().withColumn("__salt", F.pmod(F.xxhash64("__h"), F.lit(64)))
    part = F.row_number().over(Window.partitionBy(key, "__salt").orderBy("__h"))
    whole = F.row_number().over(Window.partitionBy(key).orderBy("__h"))
    low = hashes.withColumn("__r", part).where(F.col("__r") <= k).withColumn("__r", whole).where(F.col("__r") <= k)
    merged = low.groupBy(F.col(key).alias("__key")).agg(F.array_join(F.array_sort(F.collect_list("__h")), "").alias("__fp"))
    return (sketched.select(key).distinct().join(merged, F.col(key).eqNullSafe(F.col("__key")), "left")
            .select(key, F.coalesce("__fp", F.lit("")).alias("fingerprint")))


def _edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _edited_hashes(text: str, ws: list[bytes], hashes: np.ndarray, new: str) -> np.ndarray:
    """Shingle hashes of the edited text: those wholly in the kept head are the old ones."""
    head = text[: len(text) - len(text) // 4]
    kept = len(words(head)) - 1                              # the last word of the head may have grown
    ns = words(new)
    if kept < WORDS or len(ws) <= WORDS or len(ns) <= WORDS:
        return shingle_hashes(ns, WORDS, SEED)
    n = kept - WORDS + 1
    return np.concatenate([hashes[:n], shingle_hashes(ns[n:], WORDS, SEED)]) if len(ns) - n >= WORDS else hashes[:n]


def neighbour_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Each text against its edited text and the next text in ascending id order.

    The edited text has its last quarter of code points replaced by the first as many (or all) of
    the next text; after the last comes the first.  Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    One shuffle of the texts, by ``ordered_parts``, puts neighbours side by side; each part also
    gets the first text of the next part.  Equal ids are ordered by text hash, null ids come first.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    keys = cut_lineage(rows.select("doc_id", "tie"))
    part_of, n = ordered_parts(keys)
    opening = sorted((r["part"], r["first"]) for r in keys.groupBy(part_of.alias("part"))
                     .agg(F.min(F.struct("doc_id", "tie")).alias("first")).collect())      # one row per part
    seams = [(part, *opening[(i + 1) % len(opening)][1]) for i, (part, _) in enumerate(opening)]
    seams = df.sparkSession.createDataFrame(seams, "part int, next_id long, next_tie long")
    closing = (rows.join(F.broadcast(seams), F.col("doc_id").eqNullSafe(F.col("next_id")) & (F.col("tie") == F.col("next_tie")))
               .dropDuplicates(["part"]).select("part", F.lit(1).alias("role"), "doc_id", "tie", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in slices(batches, "text", 8 << 20):
            out = []
            for role, doc, text in zip(column(b, "role").to_pylist(), column(b, "doc_id").to_pylist(), texts_of(b, "text")):
                ws = words(text)
                hashes = shingle_hashes(ws, WORDS, SEED)
                sketch = bottom_k(hashes, k)
                if last is not None:
                    out.append(_finish(last, text, sketch, k))
                last = None if role else (doc, text, ws, hashes, sketch)
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    dealt = rows.select(part_of.alias("part"), F.lit(0).alias("role"), "doc_id", "tie", "text").unionByName(closing)
    return (dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "role", "doc_id", "tie")
            .select("role", "doc_id", "text").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in _RESULT.items())))


def ordered_parts(keys: DataFrame, per_part: int = 32) -> tuple[Column, int]:
    """(part number as an expression of doc_id and tie, number of parts): parts are ranges in
    ascending order of (doc_id, tie).  Their bounds are taken from the ``per_part`` keys a part
    of smallest hash, which affects only how evenly the parts are filled."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = keys.orderBy(F.xxhash64("doc_id", "tie", F.lit(7)), "doc_id", "tie").limit(n * per_part).collect()
    low = -(1 << 63)
    drawn = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["tie"]) for r in drawn)
    bounds = sorted(set(drawn[per_part::per_part]))
    if not bounds:
        return F.lit(0), 1
    key = F.struct(F.col("doc_id").isNotNull().alias("a"), F.coalesce("doc_id", F.lit(low)).alias("b"), F.col("tie").alias("c"))
    one = lambda t: F.struct(F.lit(t[0]).alias("a"), F.lit(t[1] if t[0] else low).cast("long").alias("b"),
                             F.lit(t[2]).cast("long").alias("c"))
    wide = math.isqrt(len(bounds)) + 1                       # two short scans instead of a long one
    groups = [bounds[i: i + wide] for i in range(0, len(bounds), wide)]
    below = lambda arr: F.size(F.filter(arr, lambda x: x <= key))
    group = F.greatest(below(F.array(*(one(g[0]) for g in groups))) - 1, F.lit(0))
    inner = F.element_at(F.array(*(F.array(*map(one, g)) for g in groups)), group + 1)
    return group * wide + below(inner), len(bounds) + 1


_RESULT = {"doc_id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string",
           "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
_SCHEMA = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for c, t in _RESULT.items()])


def _finish(row: tuple, following: str, next_sketch: np.ndarray, k: int) -> dict:
    doc, text, ws, hashes, sketch = row
    new = _edited(text, following)
    edited = sketch if new == text else bottom_k(_edited_hashes(text, ws, hashes, new), k)
    return {"doc_id": doc, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode()).hexdigest(),
            "fingerprint": to_hex(sketch), "edited_fingerprint": to_hex(edited),
            "near_edited": resemblance(sketch, edited, k), "near_next": resemblance(sketch, next_sketch, k)}
