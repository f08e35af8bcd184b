"""Reference-based quality metrics over answers, citations and labelled examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeway.functions import text as T
from sedgeway.operators.retrieval import together

FLOORS = {"faithfulness": 0.70, "answer_relevancy": 0.60, "context_precision": 0.70, "context_recall": 0.70}
METRICS = ["answer_accuracy", *FLOORS, "grounded_rate"]


def faithfulness(grounded: Column, answer: Column, quotes: Column) -> Column:
    """1 if not grounded, 0 if grounded on blank quotes, else how much of the answer they cover."""
    return F.when(~grounded, 1.0).when(F.coalesce(F.trim(quotes), F.lit("")) == "", 0.0).otherwise(T.coverage(answer, quotes))


def relevancy(truth: Column, expected: Column, question: Column, answer: Column) -> Column:
    """How much of the truth, else the expected answer, else the question the answer covers; blank falls through."""
    filled = lambda c: F.when(c != "", c)
    return T.coverage(F.coalesce(filled(truth), filled(expected), question), answer)


def context_scores(relevant: Column, cited: Column) -> tuple[Column, Column]:
    """Precision and recall over documents; (1, 1) without labels, (0, 0) without citations."""
    hits = T.overlap(relevant, cited)
    none, blank = F.coalesce(F.size(relevant), F.lit(0)) <= 0, F.coalesce(F.size(cited), F.lit(0)) <= 0
    part = lambda n: F.when(none, 1.0).when(blank, 0.0).otherwise(hits / n)
    return part(F.size(cited)), part(F.size(relevant))


def accuracy(expected: Column, answer: Column) -> Column:
    """1 if nothing is expected or the answer has it, whatever its case."""
    return F.when(expected.isNull() | F.contains(F.lower(answer), F.lower(expected)), 1.0).otherwise(0.0)


def holding(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """``query_id, document_id`` of documents (``document_id, text``) that hold a passage (``query_id, question``) whole.

    Pieces between single spaces are the same in a passage and around it, but for its first and last
    piece.  So documents and passages meet in an equi-join on the hash of the passage's first three
    inner pieces (of all it has, if fewer), and only those pairs are compared.  Passages of one or two
    pieces have no inner one; they are tried one by one on every document.  A null or empty passage is
    held by none.
    """
    asked = passages.where("question <> ''").select("query_id", "question", F.split("question", " ", -1).alias("p"))
    gram = lambda p, at, n: F.xxhash64(*[F.when(n > k, F.get(p, at + k)) for k in range(3)], n)
    inner = asked.where(F.size("p") > 2).withColumn("n", F.least(F.size("p") - 2, F.lit(3)))
    seeds = inner.select("query_id", "question", gram(F.col("p"), F.lit(1), F.col("n")).alias("seed"))
    lengths = [r["n"] for r in inner.select("n").distinct().collect()]  # three at most
    split = documents.select("document_id", "text", F.split("text", " ", -1).alias("p"))
    every = lambda n: F.transform(F.sequence(F.lit(1), F.size("p") - n), lambda i: gram(F.col("p"), i, F.lit(n)))
    none = F.array().cast("array<bigint>")
    usable = [F.when(F.size("p") > n, every(n)).otherwise(none) for n in lengths]
    seeded = split.select("document_id", "text", F.explode(F.array_distinct(F.concat(none, *usable))).alias("seed"))
    found = seeded.join(seeds, "seed").where(F.contains("text", "question")).select("query_id", "document_id")
    short = [(r["query_id"], r["question"]) for r in asked.where(F.size("p") < 3).select("query_id", "question").toLocalIterator()]
    if short:
        hits = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(text)), F.lit(query)) for query, text in short]))
        some = documents.select(F.explode(hits).alias("query_id"), "document_id")
        found = together([found, some])
    return found.distinct()


def score(cases: DataFrame) -> DataFrame:
    """Add the metrics to ``question, expected, truth, relevant, text, outcome, quotes, cited``."""
    grounded = F.col("outcome") == "answered"
    precision, recall = context_scores(F.col("relevant"), F.array_distinct("cited"))
    return cases.select(
        "*",
        accuracy(F.col("expected"), F.col("text")).alias("answer_accuracy"),
        faithfulness(grounded, F.col("text"), F.col("quotes")).alias("faithfulness"),
        relevancy(F.col("truth"), F.col("expected"), F.col("question"), F.col("text")).alias("answer_relevancy"),
        precision.alias("context_precision"), recall.alias("context_recall"), grounded.cast("double").alias("grounded_rate"),
    )


def report(scored: DataFrame) -> DataFrame:
    """One row of means; all 0 over no examples."""
    return scored.agg(F.count("*").alias("examples"), *[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in METRICS])


def below_floor(reported: DataFrame, floors: dict[str, float] | None = None) -> DataFrame:
    """``metric, value, floor, message`` of every metric strictly below its floor."""
    floors = FLOORS if floors is None else floors
    long = reported.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(f).alias("floor")) for m, f in floors.items()])).alias("x")).select("x.*")
    return long.where("value < floor").withColumn("message", F.format_string("%s %.3f < %.3f", "metric", "value", "floor"))


def ranking_quality(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """hit@1 and mean reciprocal rank of ``ranked(query_id, chunk_id, rank)`` against ``wanted(query_id, chunk_id)``."""
    found = ranked.join(wanted, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    every = wanted.select("query_id").distinct().join(found, "query_id", "left")
    return every.agg(F.avg((F.coalesce(F.col("rank"), F.lit(-1)) == 0).cast("double")).alias("hit_at_1"), F.avg(F.coalesce(1.0 / (F.col("rank") + 1), F.lit(0.0))).alias("mrr"))
