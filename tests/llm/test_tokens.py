"""Token files, byte BPE and packing against the tokenizer libraries themselves."""
import base64
import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from acctlens.llm import byte_bpe, packing, simple8b
from acctlens.llm.piece_encoder import encoder_for
from tests.llm.fixtures import ODD, empty_documents, odd_documents

WORD, BYTE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.01/documents.parquet"


@functools.cache
def library(path):
    return Tokenizer.from_file(path)


def whole(path, texts):
    return [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)]


def le32(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_encode_as_whole_texts(path):
    rnd = random.Random(3)
    letters = list("aB é\n\t  1'sß \u0085\x1c.,日́Σς  ᠎​ÿİ\x01<|endoftext|>")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(5000)] + [None, "", " ", "  ", "a  b", "a \n b", "x\n\n y"]
    ids, off = encoder_for(path).encode(pa.array(texts))
    assert [ids[a:z].tolist() for a, z in zip(off, off[1:])] == whole(path, [t or "" for t in texts])


@pytest.mark.parametrize("path, end", [(WORD, 49407), (BYTE, 50256)])
def test_strings_of_added_tokens(path, end):
    rnd = random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "  ", "\n", "a", "It's", "é", "<", "|"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(4000)] + ["<|endoftext|>", "x" * 100_000 + "<|endoftext|> y"]
    for some in (texts, texts[::-1], ["plain words here"] + texts[:5]):
        ids, off = encoder_for(path).encode(pa.array(some))
        assert [ids[a:z].tolist() for a, z in zip(off, off[1:])] == whole(path, some)
    assert end in encoder_for(path).encode(pa.array(["a<|endoftext|>b"]))[0].tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70000), st.integers(0, 2 ** 64 - 1)), max_size=3000))
def test_simple8b_round_trip(values):
    x = np.array(values, np.uint64)
    words, blocks, escapes = simple8b.encode_ids(x)
    assert (simple8b.decode_ids(words, escapes) == x).all()
    parts = [simple8b.decode_block(words, blocks, escapes, i) for i in range(len(blocks))]
    assert np.concatenate([np.empty(0, np.uint64), *parts]).tolist() == values
    ids, lens = simple8b.unpack_segment(simple8b.pack_segment(x, np.array([len(x)])))
    assert ids.tolist() == values and lens.tolist() == [len(x)]


def test_simple8b_packs_small_ids_tighter():
    assert len(simple8b.encode_ids(np.zeros(60000, np.uint64))[0]) < 1100
    with pytest.raises(ValueError):
        simple8b.unpack_segment(b"????" + bytes(40))


def expected_files(rows, path):
    got, start = [], 0
    for doc, text in rows:
        ids = whole(path, [text or ""])[0] + [1]
        got.append((doc, start, len(ids), zlib.crc32(le32(ids))))
        start += len(ids)
    return got


def test_token_files(spark):
    df = spark.read.parquet(SF)
    folder = simple8b.token_folder(spark)
    simple8b.write_token_files(df, WORD, folder)
    back = simple8b.read_token_files(spark, folder)
    rows = sorted((r["doc_id"], r["text"]) for r in df.collect())
    assert sorted(map(tuple, simple8b.document_digests(back).collect())) == expected_files(rows, WORD)
    some = simple8b.document_ids(back).where("doc_id = 7").first()
    assert some["ids"] == whole(WORD, [dict(rows)[7]])[0] + [1]


def test_token_files_of_odd_rows(spark):
    folder = simple8b.token_folder(spark)
    simple8b.write_token_files(odd_documents(spark), WORD, folder)
    got = [tuple(r) for r in simple8b.document_digests(simple8b.read_token_files(spark, folder)).orderBy("start").collect()]
    assert [g[0] for g in got] == sorted((d for d, _ in ODD), key=lambda d: (d is not None, d or 0))
    assert [g[1] for g in got] == [sum(h[2] for h in got[:i]) for i in range(len(got))]
    want = Counter((d, len(i) + 1, zlib.crc32(le32(i + [1]))) for (d, t), i in zip(ODD, whole(WORD, [t or "" for _, t in ODD])))
    assert Counter((g[0], g[2], g[3]) for g in got) == want


def test_token_files_of_no_rows(spark):
    folder = simple8b.token_folder(spark)
    simple8b.write_token_files(empty_documents(spark), WORD, folder)
    assert simple8b.document_digests(simple8b.read_token_files(spark, folder)).count() == 0


def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_digests(spark):
    enc = reference_encoding()
    for df in (spark.read.parquet(SF), odd_documents(spark)):
        rows = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
        want = Counter((d, len(i), hashlib.sha256(le32(i)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
                       for d, t in rows for i in [enc.encode_ordinary(t)])
        assert Counter(map(tuple, byte_bpe.round_trip_digests(df, RANKS, P.PATTERN).collect())) == want
    assert byte_bpe.round_trip_digests(empty_documents(spark), RANKS).count() == 0


def test_byte_bpe_offsets_and_decoding(spark):
    df = odd_documents(spark)
    rows = byte_bpe.encode(df, RANKS)
    for r in rows.join(df.select("doc_id", "text"), "doc_id").where("doc_id = 5 or doc_id = 8").collect():
        text = r["text"]
        raw = text.encode()
        lens = [len(reference_encoding().decode_single_token_bytes(i)) for i in r["ids"]]
        at = np.cumsum([0, *lens])
        for a, z, f, e in zip(at, at[1:], r["first_char"], r["end_char"]):
            assert raw[a:z] in text[f:e].encode()
    back = byte_bpe.decode(rows, RANKS)
    assert Counter(t for _, _, t in back.collect()) == Counter(t or "" for _, t in ODD)
    halves = spark.createDataFrame([(1, reference_encoding().encode_ordinary("\U0001F600")[:1]), (2, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r for r in byte_bpe.decode(halves, RANKS).collect()}
    assert "�" in got[1]["text"] and got[2]["text"] == ""


def test_shortest_pack_first_places_everything():
    rnd = random.Random(5)
    for _ in range(30):
        m = rnd.choice([8, 64, 2048])
        h = {rnd.randint(1, m): rnd.randint(1, 500) for _ in range(rnd.randint(1, 60))}
        packs = packing.shortest_pack_first(h, m)
        used = Counter()
        for pattern, n in packs:
            assert n > 0 and 0 < sum(pattern) <= m
            for x in pattern:
                used[x] += n
        assert used == h


def check_packing(packed, rows, max_len):
    ids = {i: x + [1] for i, x in enumerate(whole(BYTE, [t or "" for _, t in rows]))}
    want = Counter()
    for (doc, _), x in zip(rows, ids.values()):
        for s in range(0, len(x), max_len):
            want[doc, s, len(x[s: s + max_len]), zlib.crc32(le32(x[s: s + max_len])), len(x)] += 1
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in packed) == want
    seqs = defaultdict(list)
    for p in packed:
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sorted(seqs) == list(range(len(seqs)))
    total = 0
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= max_len
        total += at if at & (at - 1) == 0 else max_len
    return sum(p["length"] for p in packed) / max(total, 1)


@pytest.mark.parametrize("salt", [packing.ROWS_PER_SALT, 3])
def test_packing(spark, monkeypatch, salt):
    monkeypatch.setattr(packing, "ROWS_PER_SALT", salt)      # few rows a salt: a length is split over many
    df = spark.read.parquet(SF)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert check_packing(packing.pack_documents(df, BYTE).collect(), rows, 2048) > 0.97
    check_packing(packing.pack_documents(odd_documents(spark), BYTE, 64).collect(), ODD, 64)
    assert packing.pack_documents(empty_documents(spark), BYTE).count() == 0


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "hello world this is"), (3, None)], "doc_id long, text string")
    seqs = packing.sequences(packing.pack_documents(df, BYTE, 8, with_ids=True), 8).collect()
    want = Counter(i for x in whole(BYTE, ["a b c", "hello world this is", ""]) for i in [*x, 1])
    assert Counter(i for s in seqs for i in s["ids"][: s["n_tokens"]]) == want
    assert all(len(s["ids"]) == 8 or len(s["ids"]) & (len(s["ids"]) - 1) == 0 for s in seqs)
