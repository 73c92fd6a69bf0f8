"""Encoding, decoding and packing against the tokenizers library."""

import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, queries
from tidemark.llm.bpe import encode, encoder

ODD = "a Z é ß Σ ς İ ﬁ 한글 日本 😀 't 're ‍ ᠎ ﻿ ́ \x1c \x85 \xa0 　 \t \n 0 9 ½ - _ # <|startoftext|> <|endoftext|> <| don't".split(" ") + [" ", "  "]


def mixed(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_encoding_equals_the_library(words, texts):
    sample = [t or "" for _, t in texts] + mixed(3000, 1) + ["a" * 3000, "", " \n"]
    got = encoder(public_tokenizers.path("word_bpe_49k.json")).encode_batch(sample)
    for text, (ids, decoded, n) in zip(sample, got):
        want = words.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want)
        assert decoded == words.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz", "aé", "a"])
def test_long_words_equal_the_library(words, letters):
    rnd = random.Random(3)
    for n in (511, 512, 513, 700, 20_000):
        word = "".join(rnd.choice(letters) for _ in range(n))
        assert encoder(public_tokenizers.path("word_bpe_49k.json")).encode_batch([word])[0][0] == " ".join(map(str, words.encode(word, add_special_tokens=False).ids))


def test_long_words_take_near_linear_time():
    rnd = random.Random(4)
    start = time.time()
    for letters in ("a", "abcdefgh"):
        encoder(public_tokenizers.path("word_bpe_49k.json")).encode_batch(["".join(rnd.choice(letters) for _ in range(200_000))])
    assert time.time() - start < 30


def test_a_small_memory_changes_nothing(texts):
    import json

    from tidemark.llm.bpe import WordBPE

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        model = json.load(f)
    sample = [t or "" for _, t in texts][:80]
    assert WordBPE(model, 50).encode_batch(sample) == WordBPE(model).encode_batch(sample)


def test_encode_odd(odd_docs, clashing, no_docs, words):
    path = public_tokenizers.path("word_bpe_49k.json")
    for r in encode(odd_docs, path).join(odd_docs, "doc_id").where("doc_id not in (4, 8)").collect():
        assert r["ids"] == " ".join(map(str, words.encode(r["text"] or "", add_special_tokens=False).ids))
    assert encode(clashing, path).count() == odd_docs.count()
    assert encode(no_docs, path).count() == 0


def test_byte_ids_equal_the_library(texts):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for t in [t or "" for _, t in texts][:120] + mixed(3000, 2):
        assert own.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def check_packing(rows, texts, capacity=1024):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    assert sorted(pieces, key=repr) == sorted({d for d, _ in texts}, key=repr)
    for d, t in texts:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(pieces[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    used = 0
    for held in bins.values():
        at = 0
        for p in sorted(held, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= capacity
        used += at
    return 1 - used / (capacity * len(bins))


def test_packing_query(spark, data, texts):
    assert check_packing(queries.op5_packing(spark, data).collect(), texts) < 0.01


def test_packing_in_groups_and_twice(documents, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    run = lambda: sorted(tuple(r) for r in packing.pack(documents, path, 256, group_docs=50).collect())
    assert run() == run()
    check_packing(packing.pack(documents, path, 256, group_docs=50).collect(), texts, 256)


def test_packing_odd(odd_docs, clashing, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    once = odd_docs.where("doc_id not in (4, 8) or doc_id is null")
    check_packing(packing.pack(once, path).collect(), [(r["doc_id"], r["text"]) for r in once.collect()])
    assert packing.pack(clashing, path).count() >= odd_docs.count()
    assert packing.pack(no_docs, path).count() == 0


def test_rows_that_repeat_are_spread(spark):
    docs = spark.range(3000).selectExpr("7L as doc_id", "'the same text of a few words' as text")
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), 64, group_docs=100).collect()
    groups = {}
    for r in rows:
        groups[r["sequence_id"] >> 32] = groups.get(r["sequence_id"] >> 32, 0) + (r["start"] == 0)
    assert sum(groups.values()) == 3000 and len(groups) == 30 and max(groups.values()) < 200


def test_filling_keeps_the_bins():
    rnd = np.random.default_rng(2)
    sizes = rnd.integers(1, 1024, 500).tolist()
    got = packing.pack_group(sizes, 1024)
    first = packing.first_fit_decreasing(np.array(sizes), 1024)
    fill: dict = {}
    for i, start, n, b, at in got:
        assert fill.get(b, 0) == at
        fill[b] = at + n
    assert sum(f < 1024 for f in fill.values()) <= 1 and max(fill.values()) <= 1024
    whole = [i for i, start, n, b, _ in got if n == sizes[i] and b == first[i]]
    assert len(whole) > 0.9 * len(sizes)
    for i, size in enumerate(sizes):
        assert sorted((s, n) for j, s, n, _, _ in got if j == i)[0][0] == 0 and sum(n for j, _, n, _, _ in got if j == i) == size


def test_first_fit_decreasing():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(1, 100, 300)
    bins = packing.first_fit_decreasing(sizes, 100)
    free: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        at = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        if at == len(free):
            free.append(100)
        free[at] -= sizes[i]
        assert bins[i] == at
