"""SimHash near-duplicates with BK-trees.

``fingerprints``: 64-bit SimHash over XXH64 hashes of word shingles.  ``link`` finds all pairs of
distinct fingerprints within ``radius`` bits and returns edges that connect exactly the same
components.  ``near_duplicates`` gives each row its fingerprint and component.

Sharding is exact: the 64 bits are cut into blocks, and of two fingerprints within ``radius`` bits
at least ``blocks - radius`` blocks agree, so the pair meets in the shard of some choice of that
many blocks.  With more fingerprints, more and so longer shard keys are used.  A shard above
``SHARD`` members is dealt into chunks, and each chunk's tree meets every other chunk, so no task
holds more than a bounded number of trees.  A tree is kept as arrays: ``child[node, d]`` is the
child at distance d from the node, and a query follows only the edges d with
|d - distance(query, node)| <= radius.  All trees of a task grow and answer together with numpy.
Trees go to their queries through the shuffle on the shard key instead of a broadcast of all
trees, which would grow with the corpus.

Equal fingerprints are collapsed before linking, so a group of copies costs one node.  Null and
empty texts (no words) have fingerprint zero and link like any other.  Null ids count as largest;
a component of null ids only has a null component_id.  Repeated rows and ids give a row each; an
empty table gives none.  Columns other than the two named are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctlens.functions.components import component_roots, contract
from acctlens.llm.text import column, shingle_hashes, slices, texts_of, words
from acctlens.session import cut_lineage

SHARD = 2048
_TASK_ROWS = 1 << 16
_SHIFTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str, k: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash: a bit is 1 if it is set in over half of the shingle hashes."""
    h = shingle_hashes(words(text), k, seed)
    if len(h) == 0:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at: at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_SHIFTS[ones * 2 > len(h)].sum(dtype=np.uint64))


def with_fingerprint(df: DataFrame, text_col: str = "text", k: int = 3, name: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the fingerprint as a signed long."""
    cols = df.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            fp = np.array([fingerprint(t, k) for t in texts_of(b, text_col)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in cols), pa.array(fp, pa.int64())], names=[*cols, name])

    text = F.col(f"`{text_col}`").cast("string").alias(text_col)
    sent = df.select(*(text if c == text_col else F.col(f"`{c}`") for c in dict.fromkeys([*cols, text_col])))
    schema = type(df.schema)([sent.schema[c] for c in cols]).add(name, "long")
    return sent.mapInArrow(run, schema)


def _blocks_for(n: int, radius: int) -> int:
    """Blocks to cut into: the fewest for which a shard of evenly spread fingerprints stays small."""
    for p in range(radius + 1, radius + 4):
        if n >> (64 * (p - radius) // p) < SHARD // 4:
            return p
    return radius + 3


def _masks(p: int, radius: int) -> list[int]:
    edges = [64 * i // p for i in range(p + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in itertools.combinations(block, p - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grow_and_search(shard: np.ndarray, fps: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, tree member) within ``radius`` bits in the same shard, each pair of rows
    once.  Rows of a shard are contiguous; ``in_tree`` rows grow its BK-tree, ``asks`` rows search."""
    members = np.flatnonzero(in_tree)
    m = len(members)
    none = np.empty(0, np.int64)
    if m == 0 or not asks.any():
        return none, none
    value = fps[members]
    opens = np.flatnonzero(np.concatenate([[True], shard[members][1:] != shard[members][:-1]]))
    child = np.full((m, 65), -1, np.int32)
    node = np.repeat(opens, np.diff(np.append(opens, m)))       # each member starts at its shard's root
    item = np.setdiff1d(np.arange(m), opens, assume_unique=True)
    node = node[item]
    while len(item):
        d = np.bitwise_count(value[item] ^ value[node]).astype(np.int64)
        slot = node * 65 + d
        _, first = np.unique(slot, return_index=True)          # the first to come becomes the child
        free = first[child.ravel()[slot[first]] < 0]
        child.ravel()[slot[free]] = item[free]
        rest = np.ones(len(item), bool)
        rest[free] = False
        item, slot = item[rest], slot[rest]
        node = child.ravel()[slot].astype(np.int64)
    asking = np.flatnonzero(asks)
    root = np.full(int(shard.max()) + 1, -1, np.int64)
    root[shard[members[opens]]] = opens
    found_q, found_t = [none], [none]
    for lo in range(0, len(asking), 1 << 14):
        q = asking[lo: lo + (1 << 14)]
        n = root[shard[q]]
        q, n = q[n >= 0], n[n >= 0]
        while len(q):
            d = np.bitwise_count(fps[q] ^ value[n]).astype(np.int64)
            hit = (d <= radius) & ((members[n] < q) | ~in_tree[q])
            found_q.append(q[hit])
            found_t.append(members[n[hit]])
            lows, highs = np.maximum(d - radius, 0), np.minimum(d + radius, 64)
            next_q, next_n = [none], [none]
            for step in range(2 * radius + 1):
                at = lows + step
                on = at <= highs
                c = child[n[on], at[on]]
                there = c >= 0
                next_q.append(q[on][there])
                next_n.append(c[there].astype(np.int64))
            q, n = np.concatenate(next_q), np.concatenate(next_n)
    return np.concatenate(found_q), np.concatenate(found_t)


def link(distinct: DataFrame, n: int, radius: int = 3) -> DataFrame:
    """(a, b) edges between distinct fingerprints (column fp) whose components are those of all
    pairs within ``radius`` bits."""
    masks = _masks(_blocks_for(n, radius), radius)
    keyed = distinct.select("fp", F.explode(F.array(*(
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))).alias("s")
    ).select("s.choice", "s.key", "fp")
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    dealt = keyed.join(sizes, ["choice", "key"])
    chunks = F.ceil(F.col("size") / SHARD).cast("int")
    mine = F.pmod(F.xxhash64("fp", "choice"), chunks).cast("int")
    # chunk i's tree is asked by chunks i, i+1, ...: the member goes to each pair of chunks it is in
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(
        F.least(F.col("mine"), o).alias("tree"), F.greatest(F.col("mine"), o).alias("asker")))
    dealt = (dealt.withColumn("chunks", chunks).withColumn("mine", mine).withColumn("pair", F.explode(pairs))
             .select("choice", "key", "pair.tree", "pair.asker", "fp", "mine"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def run(rows: list[np.ndarray]):
            choice, key, tree, asker, fps, mine = rows
            opens = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(choice) != 0) | (np.diff(tree) != 0) | (np.diff(asker) != 0)])
            fps = fps.view(np.uint64)
            a, b = grow_and_search(np.cumsum(opens) - 1, fps, mine == tree, mine == asker, radius)
            x, root = contract(fps[a], fps[b])
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(root.view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            held = [np.concatenate(c) for c in zip(held, rows)] if held else rows
            if len(held[0]) >= _TASK_ROWS:                    # cut where the last shard begins
                same = np.flatnonzero(~np.logical_and.reduce([c[:-1] == c[1:] for c in held[:4]]))
                at = int(same[-1]) + 1 if len(same) else 0
                if at:
                    yield run([c[:at] for c in held])
                    held = [c[at:] for c in held]
        if held and len(held[0]):
            yield run(held)

    order = ["choice", "key", "tree", "asker"]
    return dealt.repartition(*order).sortWithinPartitions(*order, "fp").mapInArrow(search, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp (signed long), fingerprint (hex), component_id (the smallest id of the component)."""
    docs = cut_lineage(with_fingerprint(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                                        "text", k, keep=["doc_id"]))
    return components_of(docs, radius)


def components_of(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` (doc_id, fp) with fingerprint and component_id."""
    distinct = cut_lineage(docs.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = link(distinct, distinct.count(), radius)
    roots = component_roots(edges).withColumnRenamed("node", "fp")      # only linked fingerprints
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut_lineage(rooted.join(lows, "root").select("fp", "component_id"))
    return (docs.join(named, "fp")
            .select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component with all columns of ``df``: the row with the smallest id (null ids
    last); of equal ids, the first as the rows are stored."""
    names = []
    for i in range(len(df.columns) + 2):
        if (name := f"__near_{i}") not in {c.lower() for c in df.columns} and len(names) < 2:
            names.append(name)
    row, fp = names
    # rows get numbers that last: the table is written with them before they are used
    stored = cut_lineage(with_fingerprint(df.withColumn(row, F.monotonically_increasing_id()), text_col, k, fp))
    docs = stored.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(row).alias("row"), F.col(fp).alias("fp"))
    distinct = cut_lineage(docs.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")))
    roots = component_roots(link(distinct.select("fp"), distinct.count(), radius)).withColumnRenamed("node", "fp")
    kept = (distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
            .agg(F.min("first").alias("first")).select(F.col("first.row").alias(row)))
    return stored.join(kept, row, "left_semi").select(*(F.col(f"`{c}`") for c in df.columns))
