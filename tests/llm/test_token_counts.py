import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import token_counts

MODEL = P.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=MODEL)
COUNTER = token_counts.WordCounter(MODEL, {"the": len(LIB.encode("the"))}, cached=50)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab the \n\t▁é漢<s>0"), max_size=25) | st.text(max_size=15), max_size=4))
def test_counts_equal_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert COUNTER.count(texts) == [len(x) for x in LIB.encode(texts)]


def test_query_shape(spark):
    rows = [(1, "the the the of", "x", 1), (2, None, "x", 2), (None, "", "y", 3), (1, "the the the of", "x", 1), (5, "long word " * 20000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int")
    got = token_counts.token_counts(docs, MODEL).collect()
    want = [(i, len((t or "").encode()), len(LIB.encode(t or ""))) for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(docs.limit(0), MODEL).count() == 0


def test_empty_partitions(spark):
    """Frequent words are found where most partitions of the sketches are empty, and none where all are."""
    keys = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        docs = spark.createDataFrame([(i, "the the of") for i in range(20)], "doc_id long, text string").repartition(5)
        assert token_counts.frequent_words(docs) == ["the", "of"]
        assert token_counts.frequent_words(docs.limit(0)) == []
        assert {r.n_tokens for r in token_counts.token_counts(docs, MODEL).collect()} == {len(LIB.encode("the the of"))}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
