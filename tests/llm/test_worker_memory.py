"""Workers serve one operator after another: each forgets what the others keep."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from dqspark.llm import byte_cnn, common  # noqa: E402


def test_quality_scores_free_other_operators_memory(spark, tmp_path, monkeypatch):
    mark = str(tmp_path / "forgotten")
    monkeypatch.setitem(common.REMEMBERED, "another operator", lambda: open(mark, "w").close())
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in byte_cnn.quality_scores(docs, labels).collect()] == [0.5, 0.5]
    assert (tmp_path / "forgotten").exists()


def test_tokenizer_caches_are_bounded_and_repeats_forget():
    from dqspark.llm import repeats, tokens
    tok = tokens.TextTokenizer(public_tokenizers.path("word_bpe_49k.json"), cache=50)
    texts = [f"word{chr(97 + i % 26) * (i % 40 + 1)}, Größe{i} <|endoftext|> abc{chr(97 + i % 26)}{chr(97 + i // 26)}." for i in range(400)]
    assert [tok.ids(t) for t in texts] == [tok._plain(t) for t in texts]
    held = [v for v in vars(tok).values() if isinstance(v, dict)] + [v.cache_info() for v in vars(tok).values() if hasattr(v, "cache_info")]
    assert len(held) == 2 and all(isinstance(v, dict) and len(v) <= 50 for v in held)
    assert tokens.WORD_CACHE <= 1 << 18
    repeats.gram_hashes(repeats.np.zeros(200, repeats.np.uint8), 64)
    list(common.tidy(lambda batches: batches, "tokens")([]))
    assert repeats._POWERS is None
