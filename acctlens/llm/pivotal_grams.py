"""Words that are one edit apart, by pivotal grams.

Bigrams are ordered by the number of words they occur in, rarest first.  A word's prefix is its
three first bigrams of that order, with every further occurrence of the third; its pivots are the two disjoint
ones of the three of least total frequency, chosen by dynamic programming over positions.  One edit (a code point
inserted, deleted or replaced) touches at most one of two disjoint bigrams, so of two words that
are one edit apart, the one whose prefix ends earlier has a pivot in the other's prefix.

The position limit of such a match is exact: right of the edit the words agree from the pivot to the
end, left of it from the start through the pivot.  So a match is looked up by the part on the agreeing side, pivot included,
and by half of the other side: the edit is in one half of it, and the other half agrees too.  No list of
the index thus holds more than the words with one such part in common, and a frequent bigram, head
or ending does not bring its words together in one task.  Matches are verified by edit distance.

``words_of`` counts words in texts; ``near_words`` finds the pairs; ``variant_forms`` names each
word's form and root.  Null texts have no words, null ids hash as the empty text; equal rows count
each; empty tables give no rows.  Columns other than those named are ignored.  Words shorter than five
code points are left out: four bigrams are needed for three with two disjoint ones among them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctlens.llm.text import column, slices, texts_of
from acctlens.session import cut_lineage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_CHARS = 5
_HELD = 200_000                                             # distinct words a task holds before it passes them on


def typo(word: str, start: int, one_in: int) -> str:
    """The word, one code point of it deleted if ``one_in`` divides its hash (``start``: crc32 of what comes before it)."""
    h = crc32(word.encode(), start)
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def words_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
             min_count: int = 3, one_in: int = 97) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, with one code point of every ``one_in``-th (document, run)
    deleted; those of ``min_chars`` code points that occur ``min_count`` times.  Tasks add up their own first."""
    if min_chars < MIN_CHARS:
        raise ValueError(f"words need {MIN_CHARS} code points or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in slices(batches, "text", 4 << 20):
            for doc, text in zip(column(b, "doc_id").to_pylist(), texts_of(b, "text")):
                lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")      # A-Z only
                start = crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in Counter(RUN.findall(lower)).items():
                    w = typo(w, start, one_in)
                    if len(w) >= min_chars:
                        held[w] += n
                if len(held) >= _HELD:
                    yield flush()
        yield flush()

    return (df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def gram_frequencies(words: DataFrame) -> dict[str, int]:
    """Words that hold each bigram (bounded by the pairs of the alphabet's letters)."""
    at = F.sequence(F.lit(1), F.char_length("word") - 1)
    grams = words.select(F.explode(F.array_distinct(F.transform(at, lambda i: F.substring("word", i, F.lit(2))))).alias("gram"))
    return {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()}


def prefix_and_pivots(word: str, rank: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """(rank of the third bigram, positions of the prefix, positions of the two pivots)."""
    ranked = sorted((rank[word[i: i + 2]], i) for i in range(len(word) - 1))
    last = ranked[2][0]
    prefix = [i for r, i in ranked if r <= last]
    return last, prefix, cheapest_disjoint(sorted((i, r) for r, i in ranked[:3]))


def cheapest_disjoint(grams: list[tuple[int, int]], size: int = 2, want: int = 2) -> list[int]:
    """Positions of ``want`` disjoint grams of least total weight among (position, weight), by position:
    best[j] holds the cheapest choice of j grams that ends before the gram looked at."""
    ends: list[list[tuple[int, list[int]] | None]] = []     # ends[k][j]: cheapest j of the first k grams
    ends.append([(0, [])] + [None] * want)
    for k, (at, weight) in enumerate(grams):
        free = max(j for j in range(k + 1) if j == 0 or grams[j - 1][0] + size <= at)
        row = list(ends[k])
        for j in range(1, want + 1):
            before = ends[free][j - 1]
            if before is not None and (row[j] is None or before[0] + weight < row[j][0]):
                row[j] = (before[0] + weight, [*before[1], at])
        ends.append(row)
    best = ends[-1][want]
    if best is None:
        raise ValueError("no disjoint grams")
    return best[1]


def _sides(word: str, at: int) -> Iterator[tuple[str, str, str]]:
    """(side, agreeing part with the bigram, other part) for an edit to the right and to the left of it."""
    yield "r", word[: at + 2], word[at + 2:]
    yield "l", word[at:], word[:at]


def _halves(side: str, part: str, n: int) -> Iterator[tuple[str, str]]:
    """Keys of the halves of ``part`` as if it had ``n`` code points: n // 2 first ones, the others last."""
    yield f"{side}a{n // 2}", part[: n // 2]
    rest = n - n // 2
    yield f"{side}b{rest}", part[max(0, len(part) - rest):]


def index_keys(word: str, at: int) -> set[int]:
    """Where a word is listed for a bigram of its prefix."""
    return {_key(k, same, half) for side, same, other in _sides(word, at) for k, half in _halves(side, other, len(other))}


def probe_keys(word: str, at: int) -> set[int]:
    """Where a word one edit away that holds this pivot may be listed: the other part may be one code point longer or shorter."""
    return {_key(k, same, half) for side, same, other in _sides(word, at)
            for n in range(max(0, len(other) - 1), len(other) + 2) for k, half in _halves(side, other, n)}


def _key(kind: str, same: str, half: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind} {same} {half}", 0) - (1 << 63)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: both orders of every pair of ``words`` (word, n) exactly one edit apart."""
    frequency = gram_frequencies(words)
    rank = {g: r for r, (_, g) in enumerate(sorted((n, g) for g, n in frequency.items()))}

    def rows(batches: Iterator[pa.RecordBatch], probe: bool) -> Iterator[pa.RecordBatch]:
        keys = probe_keys if probe else index_keys
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for w, n in zip(column(b, "word").to_pylist(), column(b, "n").to_pylist()):
                last, prefix, pivots = prefix_and_pivots(w, rank)
                ks = set().union(*(keys(w, i) for i in (pivots if probe else prefix)))
                for col, values in zip(out, (ks, [w] * len(ks), [n] * len(ks), [last] * len(ks))):
                    col.extend(values)
                if len(out[0]) >= 50_000:
                    yield _batch(out)
                    out = ([], [], [], [])
            yield _batch(out)

    def _batch(out: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int32()))],
                                          names=["key", "w", "wn", "last"])

    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = words.select("word", "n").repartition(parts, "word")                # a word makes dozens of rows
    side = lambda probe: words.mapInArrow(lambda bs: rows(bs, probe), "key long, w string, wn long, last int")
    a, b = side(True).alias("a"), side(False).alias("b")
    # the planner sizes both sides by the words, dozens of rows a word too small for a broadcast; files are compressed too
    found = (a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.last") <= F.col("b.last")) & (F.col("a.w") != F.col("b.w")))
             .where(F.levenshtein("a.w", "b.w", 1) == 1))
    one, two = F.struct(F.col("a.w").alias("word"), F.col("a.wn").alias("n")), F.struct(F.col("b.w").alias("word"), F.col("b.wn").alias("n"))
    pairs = found.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct()
    pair = pairs.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p"))
    return pair.select(F.col("p.x.word").alias("word"), F.col("p.x.n").alias("n"), F.col("p.y.word").alias("near"), F.col("p.y.n").alias("near_n"))


def variant_forms(words: DataFrame, times: float = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n.  A word's form is its near word of largest n (ties: the
    smallest in code-point order) if that n is ``times`` the word's own or more; the root is where the
    forms lead.  With ``times`` above 1 forms never lead back."""
    if times <= 1:
        raise ValueError("times must be above 1")
    words = cut_lineage(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = -F.col("best.m") >= F.col("n") * times
    named = cut_lineage(words.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.w")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")))
    roots = roots_of(named.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return named.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots_of(steps: DataFrame) -> DataFrame:
    """word, root: each word's step (word, root) followed to its end, by doubling: a round takes every
    word as far again, so chains of length d take log2(d) rounds."""
    steps = cut_lineage(steps)
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = cut_lineage(steps.join(ahead.hint("merge"), "root", "left").select(
            "word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps
