import os

import public_tokenizers
import pytest
from tessella.llm import common, token_counts

FOLDER = "/root/testdata/sf0.001"


def library(path, text):
    """The number of tokens as the tokenizer's library itself gives it."""
    if path.endswith(".model"):
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text, add_bos=False, add_eos=False))
    import tokenizers

    return len(tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library_on_all_documents(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("the driver's tables are not here")
    path = public_tokenizers.path(token_counts.MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = token_counts.count_documents(spark, FOLDER).collect()
    assert {(r.doc_id, r.n_tokens, r.over_limit) for r in found} == {(i, n := library(path, t or ""), n > 4096) for i, t in texts.items()}


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_and_cache(spark, name, monkeypatch):
    path = public_tokenizers.path(name)
    texts = [(1, "hello <s> world"), (2, None), (3, ""), (4, "hello <s> world"), (None, " x\n\ty "), (5, "lang " * 6000)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts], "doc_id long, text string, digest int")
    cache = common.Scratch(spark, "test-cache").root
    rows = token_counts.count(spark, docs, path, cache).collect()
    plain = {(i, library(path, t or ""), len((t or "").encode())) for i, t in texts}
    assert {(r.doc_id, r.n_tokens, r.n_bytes) for r in rows} == plain and len(rows) == len(texts)
    assert [r.over_limit for r in rows if r.doc_id == 5] == [True]
    folder = f"{cache}/tokenizer={token_counts.tokenizer_digest(path)}"
    assert token_counts.stored(spark, folder).count() == 4
    more = docs.union(spark.createDataFrame([(9, "new text", 1)], docs.schema))
    assert token_counts.count(spark, more, path, cache).count() == 7
    assert token_counts.stored(spark, folder).count() == 5  # only the miss was encoded and appended
    assert token_counts.count(spark, docs.limit(0), path, cache).count() == 0
