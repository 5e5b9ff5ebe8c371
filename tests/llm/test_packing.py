import bisect
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tessella.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, sequence_id string"


def plain_best_fit(lengths, capacity):
    """Best-fit decreasing, one piece at a time: the remaining capacities."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        rooms.insert(bisect.bisect_left(rooms, (room := rooms.pop(at) if at < len(rooms) else capacity) - n), room - n)
    return sorted(rooms)


def test_plan_equals_one_by_one():
    rng = random.Random(1)
    for case in range(60):
        capacity = rng.choice([7, 16, 100, 257])
        lengths = [rng.randint(1, capacity) if rng.random() < 0.8 else rng.choice([1, capacity, capacity // 2 + 1]) for _ in range(rng.randint(0, 400))]
        counts = {n: lengths.count(n) for n in lengths}
        plan = packing.best_fit(counts, capacity)
        fill, at = {}, 0
        for k, (n, rank, first, each, offset) in enumerate(plan):
            end = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == n else counts[n]
            for r in range(rank, end):
                b = first + (r - rank) // each
                assert fill.get(b, 0) == offset + (r - rank) % each * n
                fill[b] = fill.get(b, 0) + n
        assert sorted(capacity - x for x in fill.values()) == plain_best_fit(lengths, capacity)


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    texts = ["", " ", "Hello  world's", "a b c", "x\x1cy \x1d", "<|endoftext|> a<|startoftext|>b", "é ́ É", "ΣΣ İI", "\x0b\x0c\r\n", "don't 123 ##!!", "​zero ﻿"]
    for text, ids in zip(texts, packing.word_encoder(PATH)(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_equals_tokenizer_on_all_documents(spark, monkeypatch):
    """Whatever the memos hold, or have dropped."""
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are not here")
    monkeypatch.setattr(packing, "MEMO_WORDS", 500)
    monkeypatch.setattr(packing, "MEMO_STEMS", 300)
    texts = [r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    texts += ["Ünï. ÅNGSTRÖM; µ ª º a,,,b É́ é, ab''cd `x` ^^^ ~~", "×÷ ½ x² İstanbul ﬁ naïve's 'll we've", "rock-n-roll! (x) [y] {z} a<b>c"]
    tokenizer, encode = Tokenizer.from_file(PATH), packing.word_encoder(PATH)
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(some)] == [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)]


def test_pack_round_trip(spark):
    long = "word " * 9000
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (2, None, None), (3, "", "y"), (None, "z", "y"), (4, long, None)], DOCS)
    rows = packing.pack(spark, docs, PATH).collect()
    from tokenizers import Tokenizer

    ids = np.array(Tokenizer.from_file(PATH).encode(long, add_special_tokens=False).ids + [1], "<u4").tobytes()
    four = sorted((r for r in rows if r.doc_id == 4), key=lambda r: r.piece)
    assert [(r.start, r.length) for r in four] == [(0, 4096), (4096, 4096), (8192, 809)]
    assert [r.ids_crc32 for r in four] == [zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in four]
    assert sorted(r.length for r in rows if r.doc_id != 4) == [1, 1, 2, 4, 4]
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 4096 and len(by) == 3
    assert packing.pack(spark, docs.limit(0), PATH).count() == 0
