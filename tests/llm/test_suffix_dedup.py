import hashlib
import random
from collections import Counter

import pytest
from tessella.llm import suffix_dedup as S


def plain(texts):
    """n_bytes, n_removed, n_spans, kept_sha256 by counting every string."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + S.LENGTH] for d in data for i in range(len(d) - S.LENGTH + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - S.LENGTH + 1):
            if counts[d[i : i + S.LENGTH]] > 1:
                gone[i : i + S.LENGTH] = b"\1" * S.LENGTH
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéß", k=rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(70) for _ in range(4)] + [prose(300)]
    texts = [None, "", "short", "x" * 199, "x" * 200, "y" * 201, "z" * 5000, "ab" * 700, prose(50), prose(4000)]
    for _ in range(60):
        parts = [prose(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 40)
            parts += [s[a : a + rng.choice([190, 196, 199, 200, 201, 203, 208, 215, 217, 240, 400, 9999])], prose(rng.randint(0, 60))]
        texts.append(rng.choice(["", " "]).join(parts))
    base = prose(400)
    for _ in range(40):  # near copies
        words = base.split(" ")
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    return texts + [texts[12], texts[12], texts[20], "x" * 199]


@pytest.mark.parametrize("seed, family", [(1, 1024), (2, 1024), (3, 3), (4, 1)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, seed, family):
    monkeypatch.setattr(S, "FAMILY", family)
    texts = corpus(seed)
    docs = spark.createDataFrame([(k if k != 15 else None, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, _spans_ string, at int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(spark, str(tmp_path)).collect()}
    expected = {k if k != 15 else None: x for k, x in enumerate(plain(texts))}
    assert len(found) == len(expected)
    wrong = [(k, found[k], x) for k, x in expected.items() if found[k] != x]
    assert not wrong, wrong[:5]
    assert sum(x[1] for x in found.values()) > 10_000


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert S.remove_repeats(spark, str(tmp_path)).count() == 0


def test_a_large_family_at_real_constants(spark, tmp_path):
    """A passage in more texts than a task gathers different rows of: before and after it, every text goes on differently."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(50)
    texts = [f"{prose(12)} {passage} {prose(12)}" for _ in range(S.FAMILY + 400)] + [passage, passage[:199], prose(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(spark, str(tmp_path)).collect()}
    assert found == dict(enumerate(plain(texts)))


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x" * 300, 5, 7), (2, "x" * 300, 5, 7)], "doc_id long, text string, _name int, core int")
    found = S.deduplicated(spark, docs)
    assert found.columns == ["doc_id", "text", "_name", "core", "_spans"]
    assert [[(s.start, s.end) for s in r._spans] for r in found.collect()] == [[(0, 300)]] * 2
    with pytest.raises(ValueError, match="_spans"):
        S.deduplicated(spark, docs.withColumnRenamed("core", "_spans"))
