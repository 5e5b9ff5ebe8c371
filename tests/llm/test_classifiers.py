import random
import zlib

import numpy as np
import pytest
from tessella.llm import quality_cnn, toxicity

SYLLABLES = ["ka", "lo", "mi", "ren", "to", "sha", "vel", "or", "in", "est", "and", "the"]


def corpus(rng, n):
    """(doc_id, text, toxic, quality)"""
    out = []
    for i in range(n):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(60, 200))]
        toxic, bad = int(rng.random() < 0.35), int(rng.random() < 0.35)
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(["wretchling", "dungbrain", "filthoaf"]))
        if bad:
            words = [w + rng.choice(["***", "###"]) for w in words]
        out.append((i, " ".join(words), toxic, 1 - bad))
    return out


CASES = [(toxicity, "toxic", 4, 2), (quality_cnn, "quality", 5, 0)]


@pytest.mark.parametrize("module, label, modulus, held", CASES)
def test_held_out_accuracy(spark, module, label, modulus, held):
    rows = corpus(random.Random(5), 500)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows] + [(9000, None, None), (9001, "", "y"), (None, "the " * 9000, "y"), (1, rows[1][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, x) for i, _, x, q in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = module.fitted(docs, labels)
    found = module.score(docs, model).collect()
    assert len(found) == len(rows) + 4 and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r.score for r in found}
    test = [(x if label == "toxic" else q, by[i]) for i, _, x, q in rows if zlib.crc32(str(i).encode()) % modulus == held]
    right = np.mean([(s >= 0.3) == (y == 1) for y, s in test])
    assert right > 0.9, right
    assert module.score(docs.limit(0), model).count() == 0
    assert {r.score for r in module.score(docs, module.fitted(docs, labels.limit(0))).collect()} == {0.0}


def test_windows_cover_whole_texts():
    rng = random.Random(2)
    for text in ["", "a", "x" * 500, *(t for _, t, _, _ in corpus(rng, 20))]:
        data = toxicity.normal(text)
        found = toxicity.windows(data)
        joined = b"".join(w[:-1] for w in found) + (b" " if found else b"")
        assert joined == (data if text.strip() else b"")


def test_chunks_see_every_place():
    rng = np.random.default_rng(0)
    table = rng.normal(size=(quality_cnn.WIDTH, 256, quality_cnn.FILTERS)).astype(np.float32)
    table[:, 0] = quality_cnn.PAD
    texts = [bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in (0, 1, 6, 63, 64, 65, 512, 513, 1000, 2999)]
    maxima, chunks = quality_cnn.chunk_maxima(table, texts)
    at = np.cumsum(chunks) - chunks
    whole = np.maximum.reduceat(maxima, at, axis=0)
    for text, got, n in zip(texts, whole, chunks):
        plain = [sum(table[k, text[i + k]] for k in range(6)) for i in range(len(text) - 5)]
        if plain:
            np.testing.assert_allclose(got, np.max(plain, axis=0), rtol=1e-4, atol=1e-4)
        else:
            assert (got < -100).all()
        assert n == max(1, -(-(max(1, -(-(len(text) + 6) // 64)) - 1) // 7))


def test_scores_equal_plain_compression(spark):
    """The score of a text from lengths that zstandard gives for its windows, one at a time."""
    import zstandard

    rows = corpus(random.Random(6), 200)
    model = toxicity.train([(t, x) for _, t, x, _ in rows])
    settings = zstandard.ZstdCompressionParameters.from_level(12, min_match=6, write_checksum=False, write_content_size=False, write_dict_id=False)
    filler = np.random.default_rng(0).integers(160, 256, len(model["toxic"])).astype(np.uint8).tobytes()
    preamble = bytes(range(128, 160))

    def length(content, window):
        known = zstandard.ZstdCompressionDict(content + preamble, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=known, compression_params=settings).compress(preamble + window))

    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows[:12]] + [(900, None)], "doc_id long, text string")
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, text, _, _ in [*rows[:12], (900, "", 0, 0)]:
        data, saved, at = (" " + " ".join(text.lower().split()) + " ").encode(), [], 0
        while text and at < len(data) - 1:
            end = data.find(b" ", min(at + 48, len(data) - 1))
            window, at = data[at : end + 1], end
            saved.append(length(model["ordinary"] + filler, window) - length(model["ordinary"] + model["toxic"], window))
        counts = [sum(s >= k for s in saved) for k in range(1, 9)]
        x = [*np.log1p(counts), np.log(max(len(saved), 1)), *(np.log1p(20 * c / max(len(saved), 1)) for c in counts)]
        assert abs(found[i] - 1 / (1 + np.exp(-np.clip(np.dot(x, model["weights"][:-1]) + model["weights"][-1], -40, 40)))) < 1e-9


def test_sample_takes_one_text_of_each_id(spark):
    """A repeated id brings one text to the driver, however many rows it has; clashing names are no trouble."""
    from tessella.llm import training

    docs = spark.createDataFrame([(1, f"text {k % 3}") for k in range(500)] + [(3, None), (5, "five")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 0), (5, 0)], "doc_id long, toxic int")
    rows = training.sample(docs, labels, "toxic", {1: 10, 0: 10}, 1, -1, 100)
    assert sorted(rows) == [("five", 0), ("text 0", 1)]
    with pytest.raises(ValueError, match="_score"):
        toxicity.scored(docs.withColumn("_score", docs.doc_id), None)
