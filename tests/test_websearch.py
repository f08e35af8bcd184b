"""Stems by published examples, and matching by the rules of web search."""

import pytest

from sedgeway.functions.stem import stem
from sedgeway.operators import websearch as W


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"),
     ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"),
     ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("vietnamization", "vietnam"), ("predication", "predic"), ("operator", "oper"), ("hopefulness", "hope"),
     ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("adjustable", "adjust"), ("adoption", "adopt"),
     ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("by", "by"), ("x86", "x86")],
)
def test_stem(word, want):
    assert stem(word) == want


TEXTS = {"a": "The reactor's safety systems were tested", "b": "Safety of reactors in France", "c": "A city in France, tested for noise", "d": "", "e": None, "f": "safety safety safety reactor"}


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("testing reactor", "a"), ("reactors safety", "fab"), ("safety or city", "fabc"), ("france -reactor", "c"), ('"reactor safety"', ""), ('"safety systems"', "a"), ('"safety reactor"', "f"), ('"safety of reactors"', "fb"), ('safety -"safety systems"', "fb"),
        ("noise city or reactor france", "bc"), ("zebra", ""), ("", ""), ("   ", ""), ('"', ""), ("-", ""), ("and or", ""), ("!!!", ""), ("a -", ""), ("-france", ""), ("OR", ""), ('""', ""), ("the of", ""),
    ],
)
def test_matches(spark, question, want):
    chunks = spark.createDataFrame(list(TEXTS.items()), "chunk_id string, text string")
    got = W.websearch_topk(spark.createDataFrame([(1, question), (2, "nothing")], "query_id long, question string"), chunks).where("query_id = 1").orderBy("rank").collect()
    assert "".join(r["chunk_id"] for r in got) in (want, "".join(sorted(want))) or set("".join(r["chunk_id"] for r in got)) == set(want) and all(r["score"] > 0 for r in got)


def test_order_and_blocks(spark, monkeypatch):
    chunks = spark.createDataFrame(list(TEXTS.items()), "chunk_id string, text string")
    q = spark.createDataFrame([(k, t) for k, t in enumerate(["safety", "france", "test", "city", "reactor"])], "query_id long, question string")
    one = sorted(map(tuple, W.websearch_topk(q, chunks, 2).collect()))
    assert [(r[1], r[2]) for r in one if r[0] == 0] == [("a", 1), ("f", 0)] and len(one) == 9
    monkeypatch.setattr(W, "BLOCK", 2)
    assert one == sorted(map(tuple, W.websearch_topk(q, chunks, 2).collect()))
