"""Text primitives, small talk, configuration."""

import pytest
from pyspark.sql import functions as F

from sedgeway.config import IngestionConfig, QueryOptions, Scope, WarehouseConfig, safe_identifier, safe_setting_name
from sedgeway.functions import smalltalk
from sedgeway.functions import text as T


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expr(*map(F.col, names)).alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokens, "The Cat, the cat's 2nd!") == ["the", "cat", "the", "cat", "s", "2nd"]
    assert one(spark, T.content_tokens, "The cat and THE dog") == ["cat", "dog"]
    assert one(spark, T.tokens, "réduction") == ["r", "duction"]
    assert one(spark, T.eval_tokens, "moon [1] [22] landing") == ["moon", "landing"]


def test_words_and_space(spark):
    assert one(spark, T.words, "  a b c\n ") == ["a", "b", "c"]
    assert one(spark, T.collapsed, " a \n\t b ") == "a b"
    assert one(spark, T.newlines, "a\r\nb\rc") == "a\nb\nc"


def test_coverage(spark):
    assert one(spark, T.coverage, "alpha beta", "beta gamma") == 0.5
    assert one(spark, T.coverage, "the of", "x") == 1.0
    assert one(spark, T.coverage, "alpha", "") == 0.0


@pytest.mark.parametrize("text", ["Hi!!", "  hello ", "how's it going?", "How’s it going", "THANKS.", "who are you?", "what can I ask you?", "good   morning", "ok", "Bye!", "yo"])
def test_small_talk(spark, text):
    assert one(spark, smalltalk.is_small_talk, text) is True


@pytest.mark.parametrize("text", ["", "   ", "hi, what is the refund policy?", "thanks for the report, who wrote it?", "hello world program", "help me with invoices", "good morning routine", "testing plan", None])
def test_not_small_talk(spark, text):
    assert one(spark, smalltalk.is_small_talk, text) is False


def test_configs():
    assert QueryOptions().retrieve_k == 20 and IngestionConfig().chunk_size == 512
    for bad in ({"chunk_size": 0}, {"chunk_size": 4, "chunk_overlap": 4}, {"chunk_overlap": -1}):
        with pytest.raises(ValueError):
            IngestionConfig(**bad)
    with pytest.raises(ValueError):
        QueryOptions(context_k=0)
    with pytest.raises(ValueError):
        WarehouseConfig("/tmp/x", 2001)
    assert safe_identifier("chunks_1") == "chunks_1" and safe_setting_name("app.tenant") == "app.tenant"
    for bad in ("1x", "a b", "a;drop", ""):
        with pytest.raises(ValueError):
            safe_identifier(bad)
    with pytest.raises(ValueError):
        safe_setting_name("tenant")


def test_scope():
    with pytest.raises(ValueError):
        Scope("  ")
    s = Scope("a").with_filters(document_ids=["x"]).with_filters(document_ids=[])
    assert s.namespace == "a" and s.document_ids() == [] and Scope("a").document_ids() is None
    with pytest.raises(TypeError):
        Scope("a", {"document_ids": "abc"}).document_ids()
