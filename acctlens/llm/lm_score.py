"""Cross-entropy difference of two matched n-gram models, over words or bytes.

Words (``word_difference``, the query): tokens are the A-Z-lower-cased words and an end token, which
also comes before the first word.  Both models share the vocabulary of all texts and hold its word
pairs (order 2), so they grow with the corpus; counts travel between slices of texts and ranges of
hashes, and neither the driver nor a task holds a model.  Words and pairs go by 64-bit hashes.  What
follows on smoothing, scale, score and odd rows holds for both.

Bytes (``cross_entropy_difference``): tokens are the bytes of the UTF-8 text closed by an end token (byte 0; the start counts as two of
them).  Both models share this one vocabulary of 256 tokens and the same order 3, smoothing
(Witten-Bell, down to the uniform distribution) and counting pass; the target model counts the
target texts, the background model every text.  Every token of every text is counted: nothing is
sampled, so what the tasks pass on grows with the input, while a model has at most 2**24 trigrams
by its vocabulary, which bounds what goes to the driver and back to the tasks.  The per-token loss
differences give the score: mean target loss minus mean background loss in nats, lower for texts
that are more like the target.

The background counts are scaled to the target's number of tokens, so both models smooth alike.

Null and empty texts are one end token.  Without target texts the target model is uniform.
Repeated rows count and score each; a repeated id counts as target if any of its flags says so.
An empty table gives no rows.  Columns other than those named are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctlens.llm.text import column, slices, texts_of, words
from acctlens.session import cut_lineage, sized_broadcast

_GRAMS = 1 << 24


def token_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(trigram code of every token of all texts, offsets of the texts in them)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]: ends[-1]]
    lens = np.diff(ends)
    # each text with two start tokens before it and the end token after it
    offsets = np.concatenate([[0], np.cumsum(lens + 3)])
    out = np.zeros(int(offsets[-1]), np.uint8)
    keep = np.ones(len(out), bool)
    keep[offsets[:-1]] = keep[offsets[:-1] + 1] = keep[offsets[1:] - 1] = False
    out[keep] = data
    code = out[2:].astype(np.int32)
    code |= out[1:-1].astype(np.int32) << 8
    code |= out[:-2].astype(np.int32) << 16
    token = np.ones(len(out), bool)                      # positions that are tokens, not starts
    token[offsets[:-1]] = token[offsets[:-1] + 1] = False
    return code[token[2:]], np.concatenate([[0], np.cumsum(lens + 1)])


def count_trigrams(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """code, background, target: counts over all texts and over those whose id is in ``targets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, target = {}, {}
        for b in slices(batches, "text"):
            codes, off = token_codes(column(b, "text"))
            is_target = np.repeat(column(b, "target").to_numpy(zero_copy_only=False), np.diff(off))
            for into, some in ((every, codes), (target, codes[is_target])):
                n = np.bincount(some, minlength=_GRAMS)
                at = np.flatnonzero(n)
                into["at"] = np.union1d(into.get("at", at), at)
                n = n[into["at"]]
                if "n" in into:
                    n[np.searchsorted(into["at"], into["old"])] += into["n"]
                into["n"], into["old"] = n, into["at"]
        if every:
            t = np.zeros(len(every["at"]), np.int64)
            t[np.searchsorted(every["at"], target["at"])] = target["n"]
            yield pa.RecordBatch.from_arrays([pa.array(every["at"].astype(np.int32)), pa.array(every["n"]), pa.array(t)],
                                             names=["code", "background", "target"])

    flags = sized_broadcast(targets.select(F.col(id_col).cast("long").alias("id")).distinct().withColumn("target", F.lit(True)))
    rows = (df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .join(flags, "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target")))
    return (rows.mapInArrow(run, "code int, background long, target long").groupBy("code")
            .agg(F.sum("background").alias("background"), F.sum("target").alias("target")))


def losses(codes: np.ndarray, counts: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """-log P of all 2**24 trigrams (float32) by Witten-Bell over counts ``counts * scale``."""
    c3 = np.zeros(_GRAMS, np.float32)
    c3[codes] = counts * scale
    c2 = np.bincount(codes & 0xFFFF, counts * scale, 1 << 16)
    c1 = np.bincount(codes & 0xFF, counts * scale, 1 << 8)
    p1 = _blend(c1.reshape(1, 256), np.full((1, 256), 1 / 256))[0]
    p2 = _blend(c2.reshape(256, 256), np.broadcast_to(p1, (256, 256)))
    out = c3.reshape(256, 256, 256)                      # first token, second, third
    for a in range(256):                                  # a slice at a time bounds the memory
        out[a] = -np.log(_blend(out[a].astype(np.float64), p2))
    return out.reshape(-1)


def _blend(c: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Witten-Bell by rows (contexts): (count + kinds * lower) / (total + kinds)."""
    total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True).astype(float)
    seen = total > 0
    return np.where(seen, (c + kinds * lower) / np.where(seen, total + kinds, 1), lower)


_TABLES: dict = {}


def score_against(df: DataFrame, counted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (mean nats a token), score (their difference)."""
    model = counted.toPandas().sort_values("code")       # 2**24 rows at most, by the vocabulary
    codes = model["code"].to_numpy(np.int64)
    background, target = model["background"].to_numpy(np.float64), model["target"].to_numpy(np.float64)
    scale = target.sum() / background.sum() if target.sum() else 1.0
    key = uuid.uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast((codes.astype(np.int32), background, target))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _TABLES:                            # once per worker and model
            at, b, t = shared.value
            _TABLES.clear()
            _TABLES[key] = losses(at, t), losses(at, b, scale)
        tables = _TABLES[key]
        for b in slices(batches, "text", 8 << 20):
            at, off = token_codes(column(b, "text"))
            lens = np.diff(off)
            means = [np.add.reduceat(t[at], off[:-1], dtype=np.float64) / lens for t in tables]
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(lens), *map(pa.array, means), pa.array(means[0] - means[1])],
                names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return (df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double"))


def cross_entropy_difference(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text of ``df``; ``targets`` holds the ids of the target texts."""
    return score_against(df, count_trigrams(df, targets, id_col, text_col), id_col, text_col)


# ---- word pairs

SLICE_BYTES = 4 << 20          # of text that is coded together
BUCKET_TOKENS = 2_000_000      # tokens a bucket of keys may get, on average


def _coded(a: np.ndarray) -> bytes:
    """``a`` compressed byte by byte of its items: the upper bytes are mostly 0."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).data)


def _decoded(data: bytes, dtype) -> np.ndarray:
    rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(rows.T).view(dtype).ravel()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, and the number of each key's distinct one."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return ranked[new], order[new], of


_PART = "slice long, ids array<long>, n_tokens long, target binary, lens binary, tokens binary, words binary"


def _coded_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a slice: its tokens as places in the hashes of its distinct words."""
    from pyspark import TaskContext
    at = TaskContext.get().partitionId() << 32
    for b in slices(batches, "text", SLICE_BYTES):
        known, tokens, lens = {b"": 0}, [], []
        for text in texts_of(b, "text"):
            ws = words(text)
            lens.append(len(ws) + 1)
            tokens += [known.setdefault(w, len(known)) for w in ws]
            tokens.append(0)                              # the end token, no word
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) if w else 0 for w in known), np.uint64, len(known))
        target = column(b, "target").to_numpy(zero_copy_only=False).astype(np.uint8)
        binary = [pa.array([_coded(x)], pa.binary()) for x in (target, np.array(lens, np.int64), np.array(tokens, np.uint32), hashes)]
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([column(b, "id").to_pylist()], pa.list_(pa.int64())), pa.array([len(tokens)]), *binary],
                                         names=["slice", "ids", "n_tokens", "target", "lens", "tokens", "words"])
        at += 1


class _Slice:
    """The distinct words and word pairs of a slice, each sorted by hash, and their counts."""

    def __init__(self, row: dict):
        self.id, self.ids = row["slice"], row["ids"]
        self.lens, tokens = _decoded(row["lens"], np.int64), _decoded(row["tokens"], np.uint32)
        hashes = _decoded(row["words"], np.uint64)
        self.words, _, of = _distinct(hashes)
        self.word_of = of[tokens]
        second = hashes[tokens]
        first = np.concatenate([np.zeros(1, np.uint64), second[:-1]])     # a text's first token follows an end token
        target = np.repeat(_decoded(row["target"], np.uint8), self.lens)
        mixed = first * np.uint64(0x9E3779B185EBCA87) + second * np.uint64(0xC2B2AE3D27D4EB4F)
        self.pairs, at, self.pair_of = _distinct(mixed)
        self.first, self.second = np.searchsorted(self.words, first[at]), self.word_of[at]
        self.word_counts, self.pair_counts = (
            [np.bincount(of, w, len(keys)).astype(np.uint32) for w in (None, target)]
            for keys, of in ((self.words, self.word_of), (self.pairs, self.pair_of)))


_ASK = "bucket int, slice long, keys binary, counts array<binary>"


def _asked(slice_id: int, keys: np.ndarray, counts: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """A row for each bucket (range of hashes) with keys of the slice: gaps between keys, and counts."""
    ends = np.searchsorted(keys, _starts(buckets)).tolist() + [len(keys)]
    some = [(k, a, z) for k, (a, z) in enumerate(zip(ends, ends[1:])) if z > a]
    gaps = [np.diff(keys[a:z], prepend=np.uint64(0)) for _, a, z in some]
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _, _ in some], pa.int32()), pa.array([slice_id] * len(some), pa.int64()), pa.array(map(_coded, gaps), pa.binary()),
         pa.array([[_coded(c[a:z]) for c in counts] for _, a, z in some], pa.list_(pa.binary()))], names=["bucket", "slice", "keys", "counts"])


def _starts(buckets: int) -> np.ndarray:
    return np.arange(buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets if buckets > 1 else 0)


_ANSWER = "slice long, bucket int, totals array<binary>, first binary, kinds array<long>, sums array<long>"


def _answered(table: pa.Table) -> pa.Table:
    """The totals of a bucket's keys for each slice that asked, in the order it asked; which slice
    reported a key first (bit i: with a count i above 0); once a bucket, its kinds and sums."""
    table = table.sort_by("slice")
    asked = [np.cumsum(_decoded(k.as_py(), np.uint64), dtype=np.uint64) for k in table["keys"]]
    ends = np.cumsum([0] + [len(a) for a in asked])
    keys, _, of = _distinct(np.concatenate(asked))
    del asked
    n_counts = len(table["counts"][0])
    totals, first, kinds, sums = [], np.zeros(len(of), np.uint8), [], []
    for i in range(n_counts):
        n = np.concatenate([_decoded(c[i].as_py(), np.uint32) for c in table["counts"]])
        total = np.bincount(of, n, len(keys)).astype(np.uint64)          # sums below 2**53 are exact
        has = np.flatnonzero(n)
        _, at, _ = _distinct(of[has])
        first[has[at]] |= 1 << i
        totals.append(total[of])
        kinds.append(len(at))
        sums.append(int(total.sum()))
    rows = range(table.num_rows)
    parts = [slice(a, z) for a, z in zip(ends, ends[1:])]
    once = lambda x: pa.array([x if r == 0 else [0] * n_counts for r in rows], pa.list_(pa.int64()))
    return pa.table([table["slice"], table["bucket"], pa.array([[_coded(t[p]) for t in totals] for p in parts], pa.list_(pa.binary())),
                     pa.array([_coded(first[p]) for p in parts], pa.binary()), once(kinds), once(sums)],
                    names=["slice", "bucket", "totals", "first", "kinds", "sums"])


def _answer(asked: DataFrame) -> DataFrame:
    """Written, so that every reader sees one and the same slice as the first to report a key."""
    return cut_lineage(asked.groupBy("bucket").applyInArrow(_answered, _ANSWER))


def _joined_answers(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    rows = table.sort_by("bucket")
    n = len(rows["totals"][0])
    return ([np.concatenate([_decoded(t[i].as_py(), np.uint64) for t in rows["totals"]]) for i in range(n)],
            np.concatenate([_decoded(f.as_py(), np.uint8) for f in rows["first"]]))


_SCORED = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def word_difference(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every text of ``df`` by word pairs.

    Texts are coded once, in slices.  A slice asks each bucket (range of hashes) for the totals of
    its distinct pairs by one binary row; the answer also says for which pairs the slice was the
    first to ask, so that the kinds of words after a word add up over slices in a second round, on
    words.  Keys are spread by hash and a slice sends each once, so no key is hot."""
    flags = sized_broadcast(targets.select(F.col(id_col).cast("long").alias("id")).distinct().withColumn("target", F.lit(True)))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = cut_lineage(rows.join(flags, "id", "left").select("id", "text", F.coalesce("target", F.lit(False)).alias("target"))
                        .mapInArrow(_coded_slices, _PART))
    tokens = parts.agg(F.sum("n_tokens")).first()[0] or 0
    if not tokens:
        return df.sparkSession.createDataFrame([], _SCORED)
    buckets = -(-tokens // BUCKET_TOKENS)

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part = _Slice(b.slice(i, 1).to_pylist()[0])
                yield _asked(part.id, part.pairs, part.pair_counts, buckets)

    def ask_words(left: pa.Table, right: pa.Table) -> pa.Table:
        part, (_, first) = _Slice(left.to_pylist()[0]), _joined_answers(right)
        kinds = [np.bincount(part.first, first >> i & 1, len(part.words)).astype(np.uint32) for i in (0, 1)]
        return pa.Table.from_batches([_asked(part.id, part.words, part.word_counts + kinds, buckets)])

    by_slice = lambda d: d.groupBy("slice")
    of_pairs = _answer(parts.mapInArrow(ask_pairs, _ASK))
    of_words = _answer(by_slice(parts).cogroup(by_slice(of_pairs)).applyInArrow(ask_words, _ASK))
    found = of_words.agg(*(F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in ("kinds", "sums") for i in (0, 1))).first()
    n_kinds, n = (found["kinds0"], found["kinds1"]), (found["sums0"], found["sums1"])
    scales = n[1] / n[0] if n[1] else 1.0, 1.0

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        part = _Slice(left.to_pylist()[0])
        pairs, _ = _joined_answers(right.filter(pc.field("round") == 0))
        of_word, _ = _joined_answers(right.filter(pc.field("round") == 1))
        means = []
        for i in (1, 0):
            # Witten-Bell: pair, word, uniform over the vocabulary.  A word precedes as many tokens as it is itself
            total, kinds = of_word[i] * scales[i], of_word[2 + i].astype(np.float64)
            lower = (total + n_kinds[i] / n_kinds[0]) / (n[i] * scales[i] + n_kinds[i]) if n[i] else np.full(len(total), 1 / n_kinds[0])
            seen, one = total[part.first] > 0, lower[part.second]
            k, every = kinds[part.first], (total + kinds)[part.first]
            loss = -np.log(np.where(seen, (pairs[i] * scales[i] + k * one) / np.where(seen, every, 1), one))
            means.append(np.add.reduceat(loss[part.pair_of], np.cumsum(part.lens) - part.lens) / part.lens)
        return pa.table([pa.array(part.ids, pa.int64()), pa.array(part.lens), *map(pa.array, means), pa.array(means[0] - means[1])],
                        names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    answers = [d.select("slice", "bucket", "totals", "first", F.lit(i).alias("round")) for i, d in enumerate((of_pairs, of_words))]
    return by_slice(parts).cogroup(by_slice(answers[0].unionByName(answers[1]))).applyInArrow(score, _SCORED)
