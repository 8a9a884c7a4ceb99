"""Fill-in-middle, spelling variants and the n-gram join against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from acctlens.llm import fill_middle, pivotal_grams, queries, vertical_join
from tests.llm.fixtures import ODD, empty_documents, odd_documents
from tests.llm.test_near import plain_words

SF001 = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# fill-in-middle

@pytest.mark.parametrize("values", [
    [0], range(70_000), range(0, 200_000, 3), [5, 65_535, 65_536, 65_537, 400_000], [*range(10), *range(50, 9_000, 2), *range(131_072, 140_000)],
    sorted(random.Random(4).sample(range(300_000), 90_000))])
def test_boundary_set(values):
    values = np.array(values)
    got = fill_middle.BoundarySet(values)
    assert len(got) == len(values)
    for k in {0, len(values) - 1, *random.Random(1).choices(range(len(values)), k=300)}:
        assert got.select(k) == values[k] and got.rank(int(values[k])) == k and got.rank(int(values[k]) + 1) == k + 1
    for k in (-1, len(values)):
        with pytest.raises(IndexError):
            got.select(k)


def test_containers_of_each_kind():
    kinds = [fill_middle.BoundarySet(np.array(v)).containers[0][0] for v in (range(0, 99, 7), range(0, 60_000, 3), range(60_000))]
    assert kinds == ["array", "bitmap", "run"]
    assert len(fill_middle.BoundarySet(np.array([], np.int64))) == 0


def plain_middle(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i: i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:lo], tokens[lo:hi], tokens[hi:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h4 % 100 < 20 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, "spm" if h4 % 100 < 20 else "psm", len(prefix), len(middle), sha(out), sha(text)


def test_fill_middle(spark):
    rnd = random.Random(8)
    made = [(i, "".join(rnd.choices(["<", "P", "S>", "<M", ">", "ab", " ", "\n", "é", "\U0001F600"], k=rnd.randrange(30)))) for i in range(100, 1600)]
    made += [(i, t) for i in range(2000, 2040) for t in ("<P>", "a<S>b", "x" * 70_000 + "." * 70_000, "A1 " * 60_000)]
    df = odd_documents(spark).unionByName(spark.createDataFrame(made, "doc_id long, text string"), allowMissingColumns=True)
    out = fill_middle.transform(df).withColumn("back", fill_middle.restore(F.col("output"), F.col("form")))
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2("back", 256)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_middle(d, t) for d, t in ODD + made)
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}
    assert fill_middle.transform(empty_documents(spark)).count() == 0


# spelling variants

def plain_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_counts(rows, one_in=97):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = plain_lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(w, letters):
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return ({a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters}
            | {a + c + b[1:] for a, b in cuts if b for c in letters}) - {w}


def plain_forms(counts):
    letters = sorted({c for w in counts for c in w})
    near = {w: [x for x in one_edit(w, letters) if x in counts] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def test_variants_of_the_test_tables(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = plain_forms(plain_counts(rows))
    assert Counter(map(tuple, queries.op12(spark, SF001).collect())) == want
    assert sum(1 for w in want if w[1]) > 5


def test_variants_broadcast_no_table(spark):
    """A table of words is small in its file, but not the keys made of it nor its rows on the driver."""
    words = spark.createDataFrame([(f"spelling{c}{d}", 1 + 5 * (c == d)) for c in "abcdef" for d in "abcdef"], "word string, n long")
    found = pivotal_grams.near_words(words), pivotal_grams.variant_forms(words)
    for df in found:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert Counter(map(tuple, found[1].collect())) == plain_forms({r["word"]: r["n"] for r in words.collect()})


def test_variants_of_odd_rows(spark):
    df = odd_documents(spark)
    got = pivotal_grams.variant_forms(pivotal_grams.words_of(df))
    assert Counter(map(tuple, got.collect())) == plain_forms(plain_counts(ODD))
    assert pivotal_grams.variant_forms(pivotal_grams.words_of(empty_documents(spark))).count() == 0
    with pytest.raises(ValueError):
        pivotal_grams.words_of(df, min_chars=4)
    with pytest.raises(ValueError):
        pivotal_grams.variant_forms(got, times=1)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "aéÿ"])
def test_every_near_pair_is_found(spark, alphabet):
    """Few letters make repeated bigrams and ties; words differ at their ends, inside pivots and between them."""
    rnd = random.Random(len(alphabet))
    words = {"".join(rnd.choices(alphabet, k=rnd.randrange(5, 13))) for _ in range(700)}
    for w in list(words)[:300]:
        words |= set(rnd.sample(sorted(one_edit(w, alphabet)), 3))
    words |= {"a" * n for n in range(5, 30)} | {"ab" * 400, "ab" * 400 + "a"}
    counts = {w: rnd.choice([3, 3, 5, 6, 12, 40, 100]) for w in words if len(w) >= 5}
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long").withColumn("near", F.lit(1))
    assert Counter(map(tuple, pivotal_grams.variant_forms(df).collect())) == plain_forms(counts)


def test_cheapest_disjoint_pair():
    for p in range(300):
        rnd = random.Random(p)
        grams = sorted((i, rnd.randrange(5)) for i in rnd.sample(range(8), rnd.randrange(3, 7)))
        got = pivotal_grams.cheapest_disjoint(grams)
        weight = dict(grams)
        pairs = [(a, b) for a in weight for b in weight if b >= a + 2]
        assert tuple(got) in pairs and sum(map(weight.get, got)) == min(weight[a] + weight[b] for a, b in pairs)


def test_roots_of_long_chains(spark):
    steps = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"v{i}", "w30") for i in range(5)]
    got = {r["word"]: r["root"] for r in pivotal_grams.roots_of(spark.createDataFrame(steps, "word string, root string")).collect()}
    assert got == {w: "w37" for w, _ in steps}


# n-gram join

def plain_join(rows, share=Fraction(4, 5), k=5):
    sets = []
    for _, text in rows:
        w = plain_words(text)
        sets.append(frozenset(" ".join(w[i: i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    label = list(range(len(rows)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in holders[g] if j < i)
        for j, c in common.items():
            if c >= share * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return Counter((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def planted():
    """Stars and chains of near copies, documents around one shared passage, copies in other case, sizes at the threshold."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=5))
    edit = lambda ws, n: [word() if i in set(rnd.sample(range(len(ws)), n)) else w for i, w in enumerate(ws)]
    base = [word() for _ in range(150)]
    texts = [base] + [edit(base, rnd.randrange(6)) for _ in range(150)]
    chain = [word() for _ in range(120)]
    for _ in range(25):
        texts.append(chain)
        chain = edit(chain, 1)[1:] + [word(), word()]
    passage = [word() for _ in range(60)]
    texts += [[word() for _ in range(rnd.randrange(20))] + passage + [word() for _ in range(rnd.randrange(20))] for _ in range(120)]
    texts += [[word() for _ in range(rnd.randrange(1, 9))] for _ in range(60)]
    texts += [t[: len(t) * 9 // 10] for t in texts[:40]] + [base[: 4 * len(base) // 5 + d] for d in (-2, -1, 0, 1, 2, 3)]
    rows = [" ".join(t) for t in texts] + ["", None, " ", "Zz"]
    rows += [t.upper() for t in rows[:30] if t]
    rnd.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


def check_join(df, rows):
    got = vertical_join.link_documents(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == plain_join(rows)


@pytest.mark.parametrize("rounds, pairs, fragments, size", [(8, 8, 8, 16 << 20), (8, 0, 50, 4_000), (0, 0, 1, 20_000)])
def test_join_of_planted_groups(spark, monkeypatch, rounds, pairs, fragments, size):
    """By default; by leaders alone and many ranges and fragments; by pairs alone."""
    for name, value in (("ROUNDS", rounds), ("PAIRS_A_ROW", pairs), ("FRAGMENTS", fragments), ("RANGE_BYTES", size)):
        monkeypatch.setattr(vertical_join, name, value)
    rows = planted()
    check_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_join_of_the_test_tables_and_odd_rows(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    check_join(df, [(r["doc_id"], r["text"]) for r in df.collect()])
    check_join(odd_documents(spark), ODD)
    check_join(empty_documents(spark), [])


def test_class_sketches_count_own_ngrams(spark):
    """Over several batches, ranges and copies: a bound of the n-grams that one class alone holds."""
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = vertical_join.class_sketches(df, 5, 11)
    lost = {r["short"]: r["lost"] for r in got.where("lost is not null").groupBy("short").agg(F.sum("lost").alias("lost")).collect()}
    sent = {r["short"]: (r["most"], r["least"]) for r in got.where("sent is not null and n > 0").groupBy("short").agg(F.max("sent").alias("most"), F.min("sent").alias("least")).collect()}
    sets = {vertical_join._digest(s): s for s in (vertical_join.ngram_set(t or "") for _, t in rows) if len(s)}
    held = Counter(g for s in sets.values() for g in s.tolist())
    exact = 0
    for c, s in sets.items():
        own = sum(held[g] == 1 for g in s.tolist())
        most, _ = sent[vertical_join._short(c)]
        bound = most - lost.get(vertical_join._short(c), 0)
        assert bound <= own                                 # never more, and right for a class of one batch
        exact += bound == own
    assert exact > 0.9 * len(sets)


def test_class_sketches_rows_grow_with_the_classes(spark):
    """However many ranges: one row per document, and at most one per class for what it loses."""
    df = spark.createDataFrame(planted(), "doc_id long, text string").repartition(7)
    for ranges in (3, 97):
        got = vertical_join.class_sketches(df, 5, ranges)
        lost = [r["short"] for r in got.where("lost is not null").collect()]
        assert lost and len(lost) == len(set(lost))
        assert got.where("lost is null").count() == df.count()
