"""Jaccard self-join of word n-gram sets by vertical partitioning.

A document's set holds the distinct ``k``-word shingles of its text (A-Z lower-cased); with fewer words
the whole sequence is the one shingle.  Documents link when |x & y| / |x | y| reaches a threshold.
Equal sets are one *class*, so copies are never paired.

1. ``class_sketches``: n-grams are cut by hash into as many ranges as the data need, one shuffle of 4 bytes an n-gram.
   A range knows which of its n-grams only one class holds.  A class with more such n-grams than
   the threshold lets it miss has no partner and is done; n-grams that several texts of one map
   batch hold are sent once, so a passage of many documents costs one row a batch.
2. The classes left get the global n-gram order: rarest first, ties by hash.  Partners share one of the
   first n-grams of both (the prefix filter), so these make the buckets of candidates.
3. ``overlaps``: the global order is cut into fragments of equal numbers of occurrences.  Of a candidate pair the
   overlap is counted in each fragment separately, and the partial counts are summed per pair.
4. Links are wanted for components only, so a bucket is not expanded into pairs: each member meets the
   bucket's leader, linked classes are merged, and only buckets that still hold several
   components go on.  When leaders merge no more, or few pairs are left between components, these pairs are checked one by
   one (sizes and places in the order rule most of them out), so no link between components is missed.

Null and empty texts, and texts without words, have the empty set, which links with nothing; their component
is their own id.  Each row is a document of its own, also where ids repeat; equal rows are copies.  A component's name is its
smallest id, null where all its ids are null.  An empty table gives no rows.  Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctlens.functions.components import component_roots
from acctlens.llm.text import column, shingle_hashes, slices, texts_of, words
from acctlens.session import cut_lineage, sized_broadcast

WORDS, SHARE = 5, Fraction(4, 5)
RANGE_BYTES = 8 << 20                                       # text whose n-grams make one range of step 1
FRAGMENTS = 8                                               # of step 3: as many at any size, so rows grow with the sets
PAIRS_A_ROW = 8                                             # pairs between components, a row of the buckets, that end the leader rounds
ROUNDS = 8


def ngram_set(text: str, k: int = WORDS) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the text's shingles."""
    return np.unique(shingle_hashes(words(text), k, 0))


def _digest(ngrams: np.ndarray) -> bytes:
    return blake2b(ngrams.tobytes(), digest_size=16).digest()


_SENT = {"part": pa.int32(), "doc_id": pa.int64(), "n": pa.int64(), "class": pa.binary(), "sent": pa.int64(), "classes": pa.binary(), "sizes": pa.binary(), "grams": pa.binary()}
_COUNTED = {"doc_id": pa.int64(), "n": pa.int64(), "class": pa.binary(), "sent": pa.int64(), "short": pa.int64(), "part": pa.int32(), "shorts": pa.binary(), "losses": pa.binary()}


def class_sketches(rows: DataFrame, k: int, parts: int) -> DataFrame:
    """doc_id, n, class, sent, short, lost.  One row per document with ``lost`` null and ``sent``, the number of its
    n-grams that no other class of its batch holds.  One row per class with ``lost``, how many of the n-grams that
    its senders sent other classes hold, if any (doc_id, n, class and sent null).  A range passes these on in one
    row per range of classes, where they are added up, so rows grow with the classes alone.  So a class alone
    holds the most that one sender sent less all that are lost, or more.  ``short`` is the class by its first 8 bytes;
    ``lost`` of classes that agree in them is of no use."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            sets = [ngram_set(t, k) for t in texts_of(b, "text")]
            classes = [_digest(s) if len(s) else None for s in sets]
            first = {c: s for c, s in zip(classes, sets) if c is not None}
            every = np.concatenate([np.empty(0, np.uint64), *first.values()])
            grams, of, held = np.unique(every, return_inverse=True, return_counts=True)
            who = np.repeat(np.arange(len(first)), list(map(len, first.values())))
            once = held[of] == 1                            # one class of this batch alone holds it
            sent = dict(zip(first, np.bincount(who[once], minlength=len(first)).tolist()))
            # a document's row goes to any range, but always to the same for a class
            yield _batch(_SENT, part=[int.from_bytes(c[:4], "little") % parts if c else 0 for c in classes], doc_id=column(b, "doc_id"),
                         n=list(map(len, sets)), sent=[sent.get(c, 0) for c in classes], **{"class": classes})
            own, who, shared = every[once], who[once], grams[held > 1]
            cuts = _ranges(own, parts)
            order = np.lexsort((who, cuts))
            own, who, cuts = own[order], who[order], cuts[order]
            names = [c[:8] for c in first]
            shared_cuts = _ranges(shared, parts)
            edges = np.arange(parts + 1)
            at, shared_at = np.searchsorted(cuts, edges), np.searchsorted(shared_cuts, edges)
            out: dict[str, list] = {"part": [], "classes": [], "sizes": [], "grams": []}
            for part in np.flatnonzero((np.diff(at) > 0) | (np.diff(shared_at) > 0)).tolist():
                here = slice(at[part], at[part + 1])
                holders, sizes = np.unique(who[here], return_counts=True)
                common = shared[shared_at[part]: shared_at[part + 1]]
                out["part"].append(part)
                out["classes"].append(b"".join(names[i] for i in holders.tolist()))
                out["sizes"].append(sizes.astype(np.uint32).tobytes())
                out["grams"].append(np.concatenate([own[here], common]).astype(np.uint32).tobytes())
            yield _batch(_SENT, **out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            sent = column(b, "grams").is_valid()
            docs, of = b.filter(pc.invert(sent)), b.filter(sent)
            shorts = [c and _short(c) for c in column(docs, "class").to_pylist()]
            yield _batch(_COUNTED, short=shorts, **{c: column(docs, c) for c in ("doc_id", "n", "class", "sent")})
            rows += [tuple(map(np.frombuffer, row, ("<i8", np.uint32, np.uint32)))
                     for row in zip(*(column(of, c).to_pylist() for c in ("classes", "sizes", "grams")))]
        if not rows:
            return
        shorts, code = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        # n-gram and class in one number; class 0: sent as shared
        every, at, seen = np.zeros(sum(len(r[2]) for r in rows), np.uint64), 0, 0
        for names, sizes, grams in rows:
            here = every[at: at + len(grams)]
            here[:] = grams
            here <<= np.uint64(32)
            who = np.repeat(code[seen: seen + len(names)].astype(np.uint64) + np.uint64(1), sizes)
            here[: len(who)] |= who
            at, seen = at + len(grams), seen + len(names)
        rows.clear()
        every.sort()
        every = every[np.append(True, every[1:] != every[:-1])]             # copies in other batches sent the same again
        new = np.append(True, np.diff(every >> np.uint64(32)) > 0)
        others = every[~(new & np.append(new[1:], True))] & np.uint64(0xFFFFFFFF)
        lost = np.bincount(others.astype(np.int64), minlength=len(shorts) + 1)[1:]
        shorts, lost = shorts[lost > 0], lost[lost > 0]
        to = shorts.astype(np.int64) % parts
        held = [(part, to == part) for part in np.unique(to).tolist()]
        yield _batch(_COUNTED, part=[part for part, _ in held], shorts=[shorts[at].tobytes() for _, at in held],
                     losses=[lost[at].astype("<i8").tobytes() for _, at in held])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for b in batches for row in zip(*(column(b, c).to_pylist() for c in ("shorts", "losses")))]
        if held:
            shorts, losses = (np.concatenate([np.frombuffer(x, "<i8") for x in side]) for side in zip(*held))
            shorts, of = np.unique(shorts, return_inverse=True)
            total = np.zeros(len(shorts), np.int64)
            np.add.at(total, of, losses)
            yield pa.RecordBatch.from_arrays([pa.array(shorts), pa.array(total)], names=["short", "lost"])

    sent = rows.mapInArrow(send, "part int, doc_id long, n long, class binary, sent long, classes binary, sizes binary, grams binary")
    counted = cut_lineage(sent.repartitionById(parts, F.col("part")).mapInArrow(
        count, "doc_id long, n long, class binary, sent long, short long, part int, shorts binary, losses binary"))
    docs = counted.where("shorts is null").select("doc_id", "n", "class", "sent", "short", F.lit(None).cast("long").alias("lost"))
    losses = counted.where("shorts is not null").select("part", "shorts", "losses").repartitionById(parts, F.col("part")).mapInArrow(add, "short long, lost long")
    return docs.unionByName(losses, allowMissingColumns=True)


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _batch(schema: dict, **given) -> pa.RecordBatch:
    """A batch of ``schema``; columns not given are null."""
    rows = len(next(iter(given.values())))
    return pa.RecordBatch.from_arrays([given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], t) if c in given else pa.nulls(rows, t)
                                       for c, t in schema.items()], names=list(schema))


def _ranges(grams: np.ndarray, parts: int) -> np.ndarray:
    """Ranges cut the high 32 bits of the hash evenly, so the low ones tell the n-grams of a
    range apart but for chance, and chance only makes an n-gram look shared."""
    return ((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def needed(share: Fraction, n: Column) -> Column:
    """The fewest n-grams that a partner must have in common with a set of n: ceil(share * n)."""
    return F.floor((n * share.numerator + share.denominator - 1) / share.denominator)


def link_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, share: Fraction = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``df``."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sketched = class_sketches(rows, k, -(-size // RANGE_BYTES) or 1)
    docs = sketched.where("lost is null").select("doc_id", "n", "class", "short", "sent")
    classes = docs.where("n > 0").groupBy("class", "short").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.max("sent").alias("sent"))
    alike = classes.groupBy("short").agg(F.count("*").alias("alike")).where("alike > 1")        # hardly ever any
    lost = sketched.where("lost is not null").groupBy("short").agg(F.sum("lost").alias("lost")).unionByName(
        alike.select("short", F.lit(1 << 62).alias("lost"))).groupBy("short").agg(F.max("lost").alias("lost"))
    left = classes.join(lost, "short", "left").where(F.col("sent") - F.coalesce("lost", F.lit(0)) <= F.col("n") - needed(share, F.col("n")))
    left = cut_lineage(left.select("class", "doc_id", "n", F.monotonically_increasing_id().alias("node")))
    roots = component_roots(_links(_ordered(_sets_of(rows, left, k), left), share))
    # docs -> class -> component
    of = left.join(roots, "node").select("class", "root")
    named = docs.join(of, "class", "left").withColumn("group", F.coalesce(F.col("root").cast("string"), F.hex("class")))
    lowest = named.where("n > 0").groupBy("group").agg(F.min("doc_id").alias("lowest"))
    return named.join(lowest, "group", "left").select("doc_id", F.col("n").alias("n_shingles"),
                                                      F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"))


def _sets_of(rows: DataFrame, left: DataFrame, k: int) -> DataFrame:
    """node, gram: the n-grams of the classes in ``left``, each from one of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            sets = [ngram_set(t, k) for t in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                                             names=["class", "grams"])

    ids = sized_broadcast(left.select(F.col("doc_id").alias("id")).distinct())
    texts = rows.join(ids, rows["doc_id"].eqNullSafe(ids["id"]), "left_semi")
    sets = texts.select("text").mapInArrow(run, "class binary, grams array<long>").join(left.select("class", "node"), "class")
    return cut_lineage(sets.dropDuplicates(["class"]).select("node", F.explode("grams").alias("gram")))


def _ordered(sets: DataFrame, left: DataFrame) -> DataFrame:
    """node, n, alone, grams, fragments: per class the n-grams that other classes hold too, by the global order, the
    fragment of the order that each lies in, and the number of n-grams before them, which no other class holds."""
    held = sets.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1")
    # rarity: exact up to 1023, above it in steps of about a hundredth, so the driver gets a few thousand rows at most
    held = cut_lineage(held.withColumn("rarity", F.when(F.col("held") < 1024, F.col("held")).otherwise(F.floor(F.log2("held") * 64) + 384)))
    before, at = [], 0
    for r in sorted(held.groupBy("rarity").agg(F.sum("held").alias("n")).collect()):
        before.append((r["rarity"], at, r["n"]))
        at += r["n"]
    size = max(1, -(-at // FRAGMENTS))
    before = F.broadcast(sets.sparkSession.createDataFrame(before, "rarity long, before long, occurrences long"))
    within = F.col("gram") / F.lit(2.0 ** 64) + 0.5
    fragment = F.floor((F.col("before") + within * F.col("occurrences")) / size)
    # fragments ascend in the order, so they may come first in its key
    held = held.join(before, "rarity").select("gram", (F.shiftleft(fragment, 20) + F.col("rarity")).alias("rank"))
    shared = (sets.join(held, "gram").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("o"))
              .join(left.select("node", "n"), "node"))
    return cut_lineage(shared.select("node", "n", (F.col("n") - F.size("o")).alias("alone"), F.col("o.gram").alias("grams"),
                                     F.transform("o.rank", lambda r: F.shiftright(r, 20)).alias("fragments")))


def segments_of(ordered: DataFrame) -> DataFrame:
    """node, fragment, grams: a class's n-grams cut at the fragments' bounds."""
    starts = F.filter(F.sequence(F.lit(1), F.size("grams")), lambda i: (i == 1) | (F.element_at("fragments", i) != F.element_at("fragments", F.greatest(i - 1, F.lit(1)))))
    cut = F.transform("starts", lambda s, i: F.struct(
        F.element_at("fragments", s).alias("fragment"), F.slice("grams", s, F.coalesce(F.get("starts", i + 1), F.size("grams") + 1) - s).alias("grams")))
    return ordered.withColumn("starts", starts).select("node", F.explode(cut).alias("s")).select("node", "s.fragment", "s.grams")


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """x, y, nx, ny, common: the overlaps of ``pairs`` (x, y, nx, ny), counted fragment by fragment and summed."""
    a = segments.select(F.col("node").alias("x"), "fragment", F.col("grams").alias("gx"))
    b = segments.select(F.col("node").alias("y"), "fragment", F.col("grams").alias("gy"))
    partial = pairs.join(a, "x").join(b, ["y", "fragment"]).select("x", "y", "nx", "ny", F.size(F.array_intersect("gx", "gy")).alias("common"))
    return partial.groupBy("x", "y", "nx", "ny").agg(F.sum("common").alias("common"))


def _links(ordered: DataFrame, share: Fraction) -> DataFrame:
    """a, b: links between classes, enough of them to have the components right."""
    segments = segments_of(ordered)
    tested = (F.col("n") - needed(share, F.col("n")) + 1 - F.col("alone")).cast("int")
    first = ordered.where(tested > 0).select("node", "n", "alone", F.posexplode(F.slice("grams", 1, tested)).alias("i", "gram"))
    members = cut_lineage(first.select("gram", "node", "n", (F.col("alone") + F.col("i") + 1).alias("place")))
    n_members = members.count()
    links, merged = None, -1
    for turn in range(ROUNDS + 1):
        if links is None:
            now, settled = members.withColumn("root", F.col("node")), False
        else:
            roots = component_roots(links).withColumnRenamed("root", "r")
            now = members.join(roots, "node", "left").withColumn("root", F.coalesce("r", "node")).drop("r")
            before, merged = merged, roots.where("node != r").count()
            settled = merged == before                      # the leaders find no more
        now = cut_lineage(now)
        sizes = now.groupBy("gram", "root").agg(F.count("*").alias("m")).groupBy("gram").agg(
            F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("inside"), F.count("*").alias("roots")).where("roots > 1")
        sizes = cut_lineage(sizes.select("gram", (F.col("m") * F.col("m") - F.col("inside")).alias("across")))
        across = sizes.agg(F.sum("across")).first()[0] or 0
        if across == 0:
            break
        now = now.join(sizes.select("gram"), "gram")        # buckets that hold several components
        whole = turn == ROUNDS or settled or across <= 2 * PAIRS_A_ROW * n_members
        new = overlaps(_candidates(now, share, None if whole else turn), segments).where(
            F.col("common") * (share.denominator + share.numerator) >= (F.col("nx") + F.col("ny")) * share.numerator)
        new = new.select(F.col("x").alias("a"), F.col("y").alias("b"))
        links = cut_lineage(new if links is None else links.union(new))
        if whole:
            break
    return links if links is not None else members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)


def _candidates(now: DataFrame, share: Fraction, turn: int | None) -> DataFrame:
    """x, y, nx, ny: pairs of different components that a bucket's leader of this turn makes with the others, without
    a turn all pairs; only those whose sizes and places in the order allow the threshold."""
    a = now.select("gram", F.col("node").alias("na"), F.col("n").alias("sa"), F.col("place").alias("pa"), F.col("root").alias("ra"))
    b = now.select("gram", F.col("node").alias("nb"), F.col("n").alias("sb"), F.col("place").alias("pb"), F.col("root").alias("rb"))
    if turn is not None:
        # first the one whose n-grams others hold most (its place is early, it is the likely original), then by hash
        first = F.struct((F.col("pa") / F.col("sa")).alias("k"), "na") if turn == 0 else F.struct(F.xxhash64("na", F.lit(turn)).alias("k"), "na")
        a = a.groupBy("gram").agg(F.min_by(F.struct("na", "sa", "pa", "ra"), first).alias("l")).select("gram", "l.*")
    pairs = a.join(b, "gram").where((F.col("ra") != F.col("rb")) & (F.col("na") < F.col("nb") if turn is None else F.lit(True)))
    # the first n-gram that a pair has in common is in this bucket or another; after it, the smaller rest bounds the overlap
    most = 1 + F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb"))
    least = needed(share / (1 + share), F.col("sa") + F.col("sb"))
    fits = (least <= most) & (F.least("sa", "sb") >= needed(share, F.greatest("sa", "sb")))
    x, y = F.struct("na", "sa"), F.struct(F.col("nb").alias("na"), F.col("sb").alias("sa"))
    pairs = pairs.where(fits).select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct()
    return pairs.select(F.col("x.na").alias("x"), F.col("y.na").alias("y"), F.col("x.sa").alias("nx"), F.col("y.sa").alias("ny"))
