import random

import numpy as np
import pytest

import corpus_pipeline as P
from tessella.llm import minhash, packing
from tests.llm.test_classifiers import corpus


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(7)
    rows = corpus(rng, 400)
    passage = " ".join(f"passage{k}" for k in range(60))
    docs = [(i, t, "en", f"src{i % 5}", len(t)) for i, t, _, _ in rows]
    docs += [(1000 + k, docs[k][1], "en", "src9", 1) for k in range(20)]  # copies
    docs += [(2000 + k, docs[k][1] + " tail", "en", None, 1) for k in range(10)]  # near copies
    docs += [(3000 + k, f"{docs[50 + k][1][:400]} own{k} {passage} end{k}", "en", "src1", 1) for k in range(5)]
    docs += [(4000, None, None, None, None), (4001, "", "en", "src1", 0), (None, "some words without an id", "en", "src2", 3), (5, docs[5][1], "en", "src0", 1), (4002, "long " + "word " * 9000, "en", "src3", 4)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = [(*d, "a", k, {"x": k}) for k, d in enumerate(docs)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, _score string, _key int, row struct<x:int>").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, _, x, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {i: x for i, _, x, _ in rows}


def test_each_stage(spark, tables, tmp_path):
    folder, toxic = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in P.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.collect())
        if name != "packing":
            assert docs.columns == [*P.COLUMNS, "_score", "_key", "row"]
            assert {r._score for r in seen[-1]} == {"a"} and all(r.row.x == r._key for r in seen[-1])
    start, clean, single, cut, mixed, packed = seen
    gone = {r.doc_id for r in start} - {r.doc_id for r in clean}
    assert len(gone & {i for i, x in toxic.items() if x}) > 0.9 * sum(toxic.values()) and len([i for i in gone if not toxic.get(i, 1)]) < 10

    # near duplicates against all pairs
    sets = minhash.shingle_sets([r.text for r in clean], 5)
    link = lambda a, b: len(a) and len(b) and 100 * (n := len(np.intersect1d(a, b))) >= 80 * (len(a) + len(b) - n)
    least = list(range(len(clean)))
    for i in range(len(clean)):
        for j in range(i):
            if link(sets[i], sets[j]):
                a, b = least[i], least[j]
                least = [min(a, b) if x in (a, b) else x for x in least]
    groups = {}
    for r, k in zip(clean, least):
        groups.setdefault(k, set()).add(r.doc_id)
    expected = sorted((min((x for x in g if x is not None), default=None) for g in groups.values()), key=str)
    assert sorted((r.doc_id for r in single), key=str) == expected

    # repeated passages by counting every string
    from tests.llm.test_suffix_dedup import plain

    sizes = {r.doc_id: len((r.text or "").encode()) for r in cut}
    for r, (n, removed, _, _) in zip(single, plain([r.text for r in single])):
        assert n - removed - 8 <= sizes.get(r.doc_id, 0) <= n - removed
    assert any(sizes.get(3000 + k, 0) < 400 + 50 for k in range(5))
    assert {4000, 4001, None} <= {r.doc_id for r in cut}

    # mixing: no document more than twice, and the words wanted
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in cut}
    assert max(sum(1 for r in mixed if r.doc_id == i) for i in {r.doc_id for r in mixed}) <= 2
    longest = max(len((r.text or "").split()) for r in cut)
    assert 0 <= words(mixed) - 1.5 * words(cut) <= 7 * longest

    # packing: the pieces of all rows, in gapless sequences
    encode = packing.word_encoder(packing.public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in packed) == sum(len(x) // 4 + 1 for x in encode([r.text or "" for r in mixed]))
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


def test_run_and_empty_tables(spark, tables, tmp_path):
    folder, _ = tables
    assert P.run(spark, folder).count() > 0
    for table in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
