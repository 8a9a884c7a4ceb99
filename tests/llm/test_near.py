"""SimHash components, bottom-k sketches and nearest neighbours against brute force."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from acctlens.functions import components
from acctlens.llm import bottom_k, cross_polytope, simhash_bk
from tests.llm.fixtures import ODD, empty_documents, odd_documents

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_hashes(text, k):
    w = plain_words(text)
    if not w:
        return []
    return [xxhash.xxh64_intdigest(" ".join(w[i: i + k]), 42) for i in range(max(1, len(w) - k + 1))]


def plain_simhash(text, k=3):
    h = plain_hashes(text, k)
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=3):
    label = list(range(len(fps)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    for text in [t for _, t in ODD if t is None or len(t) < 1000] + ["One two", "x", "a\x0bb\x0cc d E F"]:
        assert simhash_bk.fingerprint(text or "") == plain_simhash(text)


def expect_components(rows):
    fps = [plain_simhash(t) for _, t in rows]
    comp = plain_components(fps)
    low = {}
    for (d, _), c in zip(rows, comp):
        if d is not None:
            low[c] = min(d, low.get(c, d))
    return Counter((d, f"{f:016x}", low.get(c)) for (d, _), f, c in zip(rows, fps, comp))


def test_near_duplicates(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    for frame, want in ((df, rows), (odd_documents(spark).where("doc_id != 4 or doc_id is null"), [r for r in ODD if r[0] != 4])):
        got = simhash_bk.near_duplicates(frame).select("doc_id", "fingerprint", "component_id")
        assert Counter(map(tuple, got.collect())) == expect_components(want)
    assert simhash_bk.near_duplicates(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("shard", [simhash_bk.SHARD, 16])
def test_linking_finds_every_component(spark, monkeypatch, shard):
    """Planted balls and chains, in shards that are dealt into chunks when ``shard`` is small."""
    monkeypatch.setattr(simhash_bk, "SHARD", shard)
    rnd = random.Random(shard)
    fps = {0, 1, (1 << 64) - 1}
    for _ in range(40):
        x = rnd.getrandbits(64)
        fps.add(x)
        for _ in range(rnd.choice([0, 1, 10])):
            for _ in range(rnd.choice([1, 2, 3, 4])):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    ball = rnd.getrandbits(64)
    fps |= {ball ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}       # many in one shard
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components.component_roots(simhash_bk.link(df, len(fps))).collect()}
    label = plain_components(fps)
    groups = lambda key: {frozenset(f for f in fps if key(f) == k) for k in {key(f) for f in fps}}
    at = {f: i for i, f in enumerate(fps)}
    assert groups(lambda f: roots.get(f, f)) == groups(lambda f: label[at[f]])


def test_block_choices_cover_all_close_pairs():
    for blocks in (4, 5, 6):
        masks = simhash_bk._masks(blocks, 3)
        rnd = random.Random(blocks)
        for _ in range(500):
            a = rnd.getrandbits(64)
            b = a
            for _ in range(3):
                b ^= 1 << rnd.randrange(64)
            assert any(a & m == b & m for m in masks)


def test_bk_tree_follows_radius():
    rnd = random.Random(9)
    fps = np.array([rnd.getrandbits(64) if i % 3 else (1 << (i % 60)) for i in range(400)], np.uint64)
    shard = np.repeat([0, 1, 2, 3], 100)
    for radius in (0, 3, 20, 30):
        a, b = simhash_bk.grow_and_search(shard, fps, np.ones(400, bool), np.ones(400, bool), radius)
        want = {(i, j) for i in range(400) for j in range(i) if shard[i] == shard[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
        assert {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist())} == want


@pytest.mark.parametrize("one_task", [components.ONE_TASK, 0])
def test_components_of_long_chains(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    n = 400
    edges = [(i, i + 1) for i in range(n)] + [(1000 + (i * 7) % 50, 1000) for i in range(50)] + [(5, 5)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components.component_roots(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000 + (i * 7) % 50: 1000 for i in range(50)}
    assert components.component_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_row_of_each_component(spark):
    kept = simhash_bk.keep_one(odd_documents(spark))
    rows = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert kept.columns == odd_documents(spark).columns
    assert rows[(1, "a b c d e f g")] == 1 and rows[(2, None)] == 1 and not rows[(3, "")] and not rows[(None, None)]
    assert sum(rows.values()) == len(set(plain_components([plain_simhash(t) for _, t in ODD])))
    assert simhash_bk.keep_one(empty_documents(spark)).count() == 0


def test_sketches():
    rnd = random.Random(2)
    a, b = ([rnd.choice("abcdefgh") * 3 for _ in range(3000)] for _ in range(2))
    ta, tb = " ".join(a), " ".join(a[:1500] + b[:1500])
    sa, sb = bottom_k.sketch_text(ta), bottom_k.sketch_text(tb)
    ha, hb = set(plain_hashes(ta, 5)), set(plain_hashes(tb, 5))
    assert sa.tolist() == sorted(ha)[:128]
    assert (bottom_k.merge([sa, sb]) == np.array(sorted(ha | hb)[:128], np.uint64)).all()
    assert abs(bottom_k.resemblance(sa, sb) - len(ha & hb) / len(ha | hb)) < 0.15
    assert abs(bottom_k.containment(sa, sb) - len(ha & hb) / len(ha)) < 0.2
    assert abs(bottom_k.distinct_count(sa) / len(ha) - 1) < 0.3
    assert bottom_k.distinct_count(bottom_k.sketch_text("a b c d e f")) == 2
    none = bottom_k.sketch_text("")
    assert bottom_k.resemblance(none, none) == 1 and bottom_k.resemblance(none, sa) == 0 and bottom_k.containment(none, sa) == 1
    assert (bottom_k.from_hex(bottom_k.to_hex(sa)) == sa).all()


def test_sketches_merge_by_key(spark):
    df = odd_documents(spark).select("doc_id", "text")
    got = {r["doc_id"]: r["fingerprint"] for r in bottom_k.merge_by(bottom_k.sketch_table(df), "doc_id").collect()}
    for d in {d for d, _ in ODD}:
        h = sorted({x for e, t in ODD if e == d for x in plain_hashes(t, 5)})[:128]
        assert got[d] == "".join(f"{x:016x}" for x in h)


def plain_neighbours(rows):
    rows = [(d, t or "") for d, t in rows]
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        n = len(t) // 4
        new = t[: len(t) - n] + nxt[:n]
        sk = [bottom_k.bottom_k(np.array(plain_hashes(x, 5), np.uint64)) for x in (t, new, nxt)]
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), bottom_k.to_hex(sk[0]), bottom_k.to_hex(sk[1]),
                    bottom_k.resemblance(sk[0], sk[1]), bottom_k.resemblance(sk[0], sk[2])))
    return out


def test_neighbour_digests(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in df.collect())
    want = plain_neighbours(rows)
    assert sorted(map(tuple, bottom_k.neighbour_digests(df.repartition(7)).collect())) == want
    one = df.where("doc_id = 3")
    assert [tuple(r) for r in bottom_k.neighbour_digests(one).collect()] == plain_neighbours([r for r in rows if r[0] == 3])
    got = bottom_k.neighbour_digests(odd_documents(spark)).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((d, len(t or "")) for d, t in ODD)
    assert bottom_k.neighbour_digests(empty_documents(spark)).count() == 0


def plain_nearest(rows, k, queries):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero(queries(ids)):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def recall(got, want):
    hit = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    return hit / sum(map(len, want.values()))


def found(df, **kw):
    out = {}
    for r in cross_polytope.search(df, "vec_id % 20 = 0", **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_nearest_neighbours(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got, want = found(df), plain_nearest(rows, 20, lambda i: i % 20 == 0)
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    assert recall(got, want) >= 0.9
    x = dict(rows)
    for q, g in got.items():
        for v, s in g:
            assert abs(s - sum(a * b for a, b in zip(x[q], x[v]))) < 1e-12


def test_nearest_neighbours_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "BLOCK", 40)          # buckets are dealt into many blocks
    rnd = np.random.default_rng(4)
    rows = [(i, (rnd.normal(size=16) * rnd.uniform(0.1, 5)).tolist()) for i in range(300)]
    rows[40] = (40, (30 / 16 ** 0.5 * np.sign(rnd.normal(size=16))).tolist())       # the longest
    rows += [(1000 + i, rows[40][1]) for i in range(100)]       # copies of a query's vector
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [float("inf")] * 16), (2080, [None] + [1.0] * 15),
           (2100, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows + odd], "vec_id long, embedding array<double>, score double, key int")
    got, want = found(df, tables=12, probes=16), plain_nearest(rows, 20, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.95
    assert [v for v, _ in got[40]] == list(range(1000, 1020))
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>")
    assert len(found(few, tables=8, probes=32)[0]) == 4
    assert cross_polytope.search(df.limit(0), "vec_id % 20 = 0").count() == 0


def uneven_lengths(kind):
    """5,000 random vectors: unit ones with a long one, lognormal lengths, or both."""
    rnd = np.random.default_rng(11)
    x = rnd.normal(size=(5000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind != "outlier":
        x *= rnd.lognormal(0, 0.5, (len(x), 1))
    if kind != "lognormal":
        x[7] *= 1000
    return [(i, v) for i, v in enumerate(x.tolist())]


@pytest.mark.parametrize("kind", ["outlier", "lognormal", "both"])
def test_nearest_neighbours_of_uneven_lengths(spark, kind):
    rows = uneven_lengths(kind)
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), plain_nearest(rows, 20, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9


def test_reference_length():
    def axes(lengths):
        bands = {}
        for x in lengths:
            bands.setdefault(int(np.floor(np.log2(x))), []).append(x)
        ref = cross_polytope.reference_length([(b, len(x), float(np.mean([(y / 2.0 ** b) ** 2 for y in x]))) for b, x in bands.items()], 128)
        return np.clip(np.round((np.array(lengths) / ref) ** 2), 1, 128)

    assert (axes([3.0] * 10) == 1).all() and (axes([1e-200] * 10) == 1).all() and (axes([1e200] * 10) == 1).all()
    got = axes([1.0] * 2000 + [1e9])
    assert got[-1] == 128 and (got[:-1] == 1).all()
    for lengths in (np.random.default_rng(0).lognormal(0, 2, 3000), [1.0] * 50 + [1e9] * 50):
        assert axes(list(lengths)).sum() <= 2.5 * len(lengths)


@pytest.mark.parametrize("n", [1, 15, 30, 50])
def test_nearest_neighbours_of_small_tables(spark, n):
    rnd = np.random.default_rng(n)
    rows = [(i, v) for i, v in enumerate(rnd.normal(size=(n, 64)).tolist())]
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), plain_nearest(rows, 20, lambda i: i % 20 == 0)
    assert {q: [v for v, _ in g] for q, g in got.items()} == {q: [v for v, _ in w] for q, w in want.items() if w}


def test_nearest_neighbours_of_isolated_queries(spark):
    rnd = np.random.default_rng(5)
    x = np.eye(64)[0] + rnd.normal(size=(4400, 64)) * 0.01      # one dense cluster, queries elsewhere
    x[:200:20] = rnd.normal(size=(10, 64)) - 10 * np.eye(64)[0]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in cross_polytope.search(df, "vec_id % 20 = 0 and vec_id < 200").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = plain_nearest(rows, 20, lambda i: (i % 20 == 0) & (i < 200))
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    assert all(g == [v for v, _ in want[q]] for q, g in got.items())


def test_ids_of_a_hot_vector(spark, capsys):
    rows = spark.range(3000).selectExpr("id as vec_id", "array(if(id % 3 = 0, 1.0, id), 2.0) as v")
    got = cross_polytope.distinct_vectors(rows, 21)
    assert {r["key"]: r["ids"] for r in got.collect()} == {0: [0, 1, *range(3, 60, 3)]} | {i: [i] for i in range(2, 3000) if i % 3}
    got.explain()
    plan = capsys.readouterr().out                            # read from the end: ids are cut to 21 before they are collected
    assert "WindowGroupLimit" in plan and plan.index("collect_list") < plan.index("WindowGroupLimit")


def test_nearest_neighbours_do_not_depend_on_the_size_of_blocks(spark, monkeypatch):
    """The method is the same below and above one block: nothing is searched whole for the table's size."""
    rnd = np.random.default_rng(8)
    rows = [(i, v) for i, v in enumerate(rnd.normal(size=(2000, 32)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").where("vec_id % 20 > 0 or vec_id < 400")
    got = found(df, tables=6, probes=8)
    monkeypatch.setattr(cross_polytope, "BLOCK", 64)
    assert got == found(df, tables=6, probes=8)
    assert recall(got, plain_nearest([r for r in rows if r[0] % 20 or r[0] < 400], 20, lambda i: i % 20 == 0)) < 1
