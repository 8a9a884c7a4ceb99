"""Connected components by alternating large-star and small-star rounds.

Edges only, as a DataFrame; each round is a grouped minimum joined back to its edges (a join that
adaptive execution may split at a hot node), written to the shared checkpoint folder.  Before the
rounds, each task contracts its own edges, so mostly few rounds and rows are left.  Nodes may be
longs or strings; a component is named by its smallest node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctlens.session import cut_lineage

_ROUNDS = 60
ONE_TASK = 200_000                                        # edges that one task may hold


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of every node but the smallest, for these edges."""
    values, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u):]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _contract_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's edges together (at most ``ONE_TASK``)."""
    held = [b for b in batches if b.num_rows]
    if held:
        yield from _contract_parts(pa.Table.from_batches(held).combine_chunks().to_batches())


def _contract_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        u, v = contract(*(b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
        kind = b.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], names=["a", "b"])


def component_roots(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node of its component."""
    kind = edges.schema["a"].dataType.simpleString()
    e = cut_lineage(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    if e.count() <= ONE_TASK:
        e = cut_lineage(e.coalesce(1).mapInArrow(_contract_all, f"a {kind}, b {kind}"))
    else:
        e = _star_rounds(cut_lineage(e.mapInArrow(_contract_parts, f"a {kind}, b {kind}").distinct()))       # a > b
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _star_rounds(e: DataFrame) -> DataFrame:
    """(node, root) of every node but the roots."""
    seen = None
    for _ in range(_ROUNDS):
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == seen:
            return e
        seen = state
        # large star: larger neighbours of a node go to the least of its neighbours and itself
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut_lineage(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("p"))
        e = cut_lineage(small.select("p.a", "p.b").where(F.col("a") != F.col("b")).distinct())
    raise RuntimeError(f"components did not settle in {_ROUNDS} rounds")
