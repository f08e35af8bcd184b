"""The engine: ingest sources into a scope, and answer whole batches of questions.

Answers are a lazy plan; what is gathered while it is built are the batch's tokens and vectors, counted first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeway.config import IngestionConfig, QueryOptions, Scope, WarehouseConfig
from sedgeway.functions import smalltalk
from sedgeway.functions import text as T
from sedgeway.operators import answer, chunking, context, embedding, evaluate, layout, retrieval
from sedgeway.operators.store import CHUNKS, Store
from sedgeway.sources import files, parsers, shared

MODEL = "hashing-blake2b"
PARSED = "content_hash string, format string, page int, text string"


@dataclass(frozen=True)
class Seams:
    """Where models plug in: batch functions, each with an offline default."""

    embedder: Callable[[list[str]], list] | None = None
    reranker: Callable | None = None
    rewriter: Callable | None = None
    contextualizer: Callable | None = None
    chunker: Callable[[str, int, int], list] | None = None
    classifier: Callable[[DataFrame], Column] | None = None
    transcriber: Callable[[bytes], str] | None = None
    parsers: dict[str, Callable[[bytes], list[str]]] = field(default_factory=dict)
    embedding_model: str = MODEL
    #: Names the parsers and the contextualizer in the caches; another name reads and writes other entries.
    version: str = "1"


def retrieve(questions: DataFrame, chunks: DataFrame, options: QueryOptions | None = None, channels: list[DataFrame] | None = None, reranker: Callable | None = None) -> DataFrame:
    """Context rows ``query_id, marker, rank, score, chunk_id, document_id, page, text`` of a question batch.

    Without ``channels`` the lexical one alone is used.  Retrieve, fuse, rerank, gate, cut, arrange.
    """
    options = options or QueryOptions()
    lists = channels or [retrieval.lexical_topk(questions, chunks, options.retrieve_k)]
    fused = retrieval.fuse(lists, options.retrieve_k)
    texts = chunks.select("chunk_id", "document_id", "page", "text")
    rows = texts.join(fused, "chunk_id").join(questions.select("query_id", "question"), "query_id")  # retrieve_k rows a question
    ranked = retrieval.rerank_with(rows, reranker, options.rerank_k) if reranker else retrieval.rerank(rows, options.rerank_k)
    return retrieval.edges(retrieval.gate(ranked, options.min_score, options.context_k)).select(
        "query_id", "marker", "rank", "score", "chunk_id", "document_id", "page", "text"
    )


def answered(questions: DataFrame, context_rows: DataFrame, generate: Callable | None = None) -> DataFrame:
    """``query_id, question, text, outcome, grounded, sources`` for every question, small talk included.

    ``generate`` is the seam for a model: a function from a Series of prompts to a Series of texts.
    """
    q = questions.withColumn("small_talk", smalltalk.is_small_talk(F.col("message") if "message" in questions.columns else F.col("question")))
    rows = q.join(answer.context(context_rows), "query_id", "left").withColumn("sources", F.when(~F.col("small_talk"), F.col("sources")))
    if generate is None:
        text = answer.extractive(F.col("question"), F.col("sources"))
        talk = F.lit(answer.SMALL_TALK_REPLY)
    else:
        said = F.pandas_udf(generate, "string")
        text = F.when(F.coalesce(F.size("sources"), F.lit(0)) <= 0, answer.NOT_FOUND).otherwise(said(answer.prompt(F.col("question"), F.col("sources"))))
        talk = said(answer.small_talk_prompt(F.col("question")))
    rows = rows.withColumn("text", F.when(F.col("small_talk"), talk).otherwise(text))
    rows = rows.withColumn("outcome", answer.outcome(F.col("text"), F.col("small_talk")))
    return rows.select("query_id", "question", "text", "outcome", (F.col("outcome") == "answered").alias("grounded"), "sources")


def trace(questions: DataFrame, context_rows: DataFrame, answers: DataFrame, tenant: str, candidates: DataFrame | None = None) -> DataFrame:
    """Spans of each question, ``tenant, query_id, seq, name, detail``: rewrite, retrieve, rerank, prompt, generate, or converse.

    detail is JSON: ids found, kept and dropped, what reached the prompt, and the numbers of the answer.
    ``candidates(query_id, chunk_id)`` are what retrieval found, by default what the context has.
    """
    ids = lambda rows, name: rows.groupBy("query_id").agg(F.array_sort(F.collect_list("chunk_id")).alias(name))  # noqa: E731  retrieve_k at most
    kept = context_rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("marker", "chunk_id"))), lambda x: x["chunk_id"]).alias("placed"))
    found = ids(candidates if candidates is not None else context_rows, "found")
    talk = smalltalk.is_small_talk(F.col("message") if "message" in questions.columns else F.col("question"))
    told = answers.select("query_id", "outcome", "text", F.size(T.words(F.col("text"))).alias("tokens"), "grounded")
    rows = questions.withColumn("talk", talk).join(kept, "query_id", "left").join(found, "query_id", "left").join(told, "query_id")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("placed", "found")})
    cited = F.when(F.col("grounded"), F.size(F.filter(answer.marked(F.col("text")), lambda m: (m >= 1) & (m <= F.size("placed"))))).otherwise(0)
    span = lambda n, name, **detail: F.struct(F.lit(n).alias("seq"), F.lit(name).alias("name"), F.to_json(F.struct(*[v.alias(k) for k, v in detail.items()])).alias("detail"))
    last = lambda n, name: span(n, name, outcome=F.col("outcome"), tokens=F.col("tokens"), grounded=F.col("grounded"), citations=cited)
    full = F.array(
        span(0, "rewrite", question=F.col("question")), span(1, "retrieve", candidates=F.size("found"), ids=F.col("found")),
        span(2, "rerank", kept=F.size("placed"), ids=F.array_sort("placed"), dropped=F.array_except("found", "placed")), span(3, "prompt", sources=F.size("placed"), ids=F.col("placed")), last(4, "generate"),
    )
    return rows.select(F.lit(tenant).alias("tenant"), "query_id", F.explode(F.when(F.col("talk"), F.array(last(0, "converse"))).otherwise(full)).alias("s")).select("tenant", "query_id", "s.*")


class Engine:
    """Sources in, answers out, one namespace at a time."""

    def __init__(self, spark: SparkSession, config: WarehouseConfig, ingestion: IngestionConfig | None = None, options: QueryOptions | None = None, seams: Seams | None = None) -> None:
        self.spark, self.config, self.store = spark, config, Store(spark, config)
        self.ingestion, self.options, self.seams = ingestion or IngestionConfig(), options or QueryOptions(), seams or Seams()

    def migrate(self) -> None:
        self.store.migrate()

    def ingest_folder(self, scope: Scope, path: str) -> DataFrame:
        return self.ingest(scope, files.scan_folder(self.spark, path))

    def ingest(self, scope: Scope, sources: DataFrame) -> DataFrame:
        """Ingest ``source, content, media_type, ingest_seq``; returns ``source, document_id, chunk_count, text_pages, vision_pages, deduplicated, error``.

        Stored contents and repeats in the batch are skipped before anything is parsed.
        """
        every = files.identify(sources.withColumn("namespace", F.lit(scope.namespace)))
        stored = self.store.read("documents", Scope(scope.namespace))
        fresh = files.new_sources(every, stored).withColumn("format", files.route(F.col("source"), F.col("media_type"), F.col("content")))
        read = self._staged("pages", self._pages(fresh))  # parsed once, read by chunks, counts and errors
        about = self._staged("sources", fresh.select("namespace", "document_id", "source", "content_hash", F.col("ingest_seq").cast("long").alias("ingest_seq")))
        ok = about.join(read.where("error is not null").select("document_id"), "document_id", "left_anti").select(about.columns)
        rows = self._chunks(about, read)
        staged = self._staged("chunks", rows.select(*[c.split()[0] for c in CHUNKS.split(", ")]))
        result = self._staged("results", self._results(every, about, read, staged))
        self.store.upsert(scope, ok, staged)
        shared.discard(read, about, staged)
        return result

    def _pages(self, fresh: DataFrame) -> DataFrame:
        """Pages of new sources, ``document_id, page, route, text, error``: from the parse cache, else parsed, else transcribed."""
        image = F.lower("source").rlike(r"\.(png|jpe?g|gif|webp|tiff?|bmp)$") | F.coalesce(F.lower("media_type").startswith("image/"), F.lit(False))
        scans = fresh.where(image).select("document_id", F.lit(1).alias("page"), F.lit("vision").alias("route"), F.col("source").alias("image_ref"), F.col("content").alias("image_data"), F.lit("").alias("text"), F.lit(None).cast("string").alias("error"))
        typed = self.cached(fresh.where(~image)).select(
            "document_id", "page", F.lit("text").alias("route"), F.lit(None).cast("string").alias("image_ref"), F.lit(None).cast("binary").alias("image_data"), "text", "error"
        )
        pages = typed.unionByName(scans)
        if self.seams.classifier is not None:
            pages = pages.withColumn("route", self.seams.classifier(pages))
        return layout.transcribed(pages, self.seams.transcriber).select("document_id", "page", "route", "text", "error")

    def cached(self, fresh: DataFrame) -> DataFrame:
        """``document_id, page, text, error`` of sources, parsed only where the cache has no pages of the same content, format and parsers.

        The cache is shared by namespaces, as equal content has equal pages; what couldn't be read isn't kept.
        """
        path = f"{self.config.path.rstrip('/')}/_parsed/version={self.seams.version}"
        key = ["content_hash", "format"]
        held = self.spark.read.schema(PARSED).parquet(path) if self.store.exists(path) else self.spark.createDataFrame([], PARSED)
        new = fresh.join(held.select(*key).distinct(), key, "left_anti")
        pages = self._staged("parsed", parsers.parse(new, self.seams.parsers).join(fresh.select("document_id", *key), "document_id"))
        known = held.join(fresh.select("document_id", *key), key).select("document_id", "page", "text", F.lit(None).cast("string").alias("error"))
        known = self._staged("known", known)
        good = pages.join(pages.where("error is not null").select("document_id").distinct(), "document_id", "left_anti")
        good.select(*key, "page", "text").distinct().write.mode("append").parquet(path)
        return pages.select("document_id", "page", "text", "error").unionByName(known)

    def _chunks(self, about: DataFrame, read: DataFrame) -> DataFrame:
        chunks = chunking.markdown_chunks(read.where("error is null"), self.ingestion.chunk_size, self.ingestion.chunk_overlap, self.seams.chunker)
        chunks = chunks.join(about.select("document_id", "source", "namespace"), "document_id")
        to_embed = F.col("text")
        if self.ingestion.contextualize:
            full = read.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n").alias("full_text"))
            chunks = chunks.join(full, "document_id")
            if self.seams.contextualizer is not None:
                return self._embedded(self._contextualized(chunks))
            else:
                to_embed = context.heading_window(F.col("source"), F.col("headings"), F.col("text"), F.col("full_text"))
        return self._embedded(chunks.withColumn("embed_text", to_embed))

    def _contextualized(self, chunks: DataFrame) -> DataFrame:
        """``embed_text`` by the model, which is asked only for chunks whose document and chunk the cache doesn't have."""
        path = f"{self.config.path.rstrip('/')}/_contexts/version={self.seams.version}"
        keyed = chunks.withColumn("context_key", F.sha2(F.concat_ws("\0", "full_text", "chunk_id", "text"), 256))
        schema = "context_key string, embed_text string"
        held = self.spark.read.schema(schema).parquet(path) if self.store.exists(path) else self.spark.createDataFrame([], schema)
        held = self._staged("contexts", held.join(keyed.select("context_key").distinct(), "context_key", "left_semi"))
        new = keyed.join(held.select("context_key"), "context_key", "left_anti").dropDuplicates(["context_key"])
        made = self._staged("contexts", new.select("context_key", context.contextualized(F.col("text"), F.col("full_text"), self.seams.contextualizer).alias("embed_text")))
        made.write.mode("append").parquet(path)
        return keyed.join(held.unionByName(made).dropDuplicates(["context_key"]), "context_key").drop("context_key")

    def _embedded(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("embedding", embedding.embed(F.col("embed_text"), self.config.embedding_width, self.seams.embedder))
        return rows.withColumn("embedding_model", F.lit(self.seams.embedding_model)).withColumn("metadata", F.create_map().cast("map<string,string>"))

    def _results(self, every: DataFrame, fresh: DataFrame, read: DataFrame, chunks: DataFrame) -> DataFrame:
        counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
        routes = layout.route_counts(read, "document_id")
        errors = read.groupBy("document_id").agg(F.first("error", ignorenulls=True).alias("error"))
        first = fresh.select("document_id", "ingest_seq", F.lit(True).alias("first"))
        rows = every.select("source", "document_id", "ingest_seq").join(first, ["document_id", "ingest_seq"], "left")
        for extra in (counts, routes, errors):
            rows = rows.join(extra, "document_id", "left")
        new = F.coalesce("first", F.lit(False))
        zero = lambda c: F.when(new, F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
        return rows.select("source", "document_id", zero("chunk_count"), zero("text_pages"), zero("vision_pages"), (~new).alias("deduplicated"), F.when(new, F.col("error")).alias("error"))

    def _staged(self, name: str, rows: DataFrame) -> DataFrame:
        """Each row is made once, though it is checked and then written; what is left goes with the driver."""
        import uuid

        path = f"{self.config.path.rstrip('/')}/_staged/{name}-{uuid.uuid4().hex}"
        return shared.written_to(rows, path)

    def ask(self, scope: Scope, questions: DataFrame, rewrite: bool = False, generate: Callable | None = None) -> DataFrame:
        """Answer ``questions(query_id, question[, history])``; see :func:`answered`.

        History takes part only with ``rewrite``; small talk is told from the message as it came.
        """
        q = questions.withColumn("message", F.col("question"))
        if rewrite and "history" in questions.columns:
            model = self.seams.rewriter
            q = q.withColumn("question", answer.rewrite_with(F.col("question"), F.col("history"), model) if model else answer.rewrite(F.col("question"), F.col("history")))
        q = q.select("query_id", "question", "message")
        chunks = self.store.read("chunks", scope)
        asked = q.where(~smalltalk.is_small_talk(F.col("message")))
        return answered(q, self.context(asked, chunks), generate)

    def context(self, questions: DataFrame, chunks: DataFrame) -> DataFrame:
        k = self.options.retrieve_k
        vectors = questions.select("query_id", embedding.embed(F.col("question"), self.config.embedding_width, self.seams.embedder).alias("vector"))
        dense = retrieval.dense_topk(vectors, chunks.select("chunk_id", F.col("embedding").alias("vector")), k)
        return retrieve(questions, chunks, self.options, [dense, retrieval.lexical_topk(questions, chunks, k)], self.seams.reranker)

    def evaluate(self, scope: Scope, examples: DataFrame) -> DataFrame:
        """Scored examples ``query_id, question, expected, truth, relevant_sources``."""
        answers = self.ask(scope, examples.select("query_id", "question"))
        cited = answer.citations(answers).groupBy("query_id").agg(F.collect_set("document_id").alias("cited"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "quote"))), lambda x: x["quote"]), " ").alias("quotes"))
        names = self.store.read("documents", Scope(scope.namespace)).select(F.col("source").alias("name"), F.col("document_id").alias("rid"))
        wanted = examples.select("query_id", F.explode("relevant_sources").alias("name")).join(names, "name").groupBy("query_id").agg(F.collect_set("rid").alias("relevant"))
        none = F.array().cast("array<string>")
        cases = examples.join(answers.drop("question"), "query_id").join(cited, "query_id", "left").join(wanted, "query_id", "left")
        return evaluate.score(cases.withColumn("relevant", F.coalesce("relevant", none)).withColumn("cited", F.coalesce("cited", none)))

    def stream(self, scope: Scope, question: str, model: Callable[[str], Iterator[str]]) -> Iterator[tuple[str, str]]:
        """One question answered by a model that streams: tokens as they come, and the whole at last; not found without a source."""
        q = self.spark.createDataFrame([(1, question)], "query_id long, question string")
        rows = answer.context(self.context(q, self.store.read("chunks", scope)))
        made = rows.select(answer.prompt(F.lit(question), F.col("sources")).alias("p")).first()
        if made is None:
            yield "complete", answer.NOT_FOUND
            return
        yield from answer.streamed(made["p"], model)

    def delete_document(self, scope: Scope, document_id: str) -> None:
        self.store.delete_document(scope, document_id)

    def purge(self, scope: Scope) -> None:
        self.store.purge(scope)


GOLDEN_CORPUS = {
    "space.txt": "The Moon circles our planet once a month. It is the only natural satellite that Earth has.",
    "python.txt": "Guido van Rossum created Python, a programming language of high level.",
    "biology.txt": "In a cell, ATP comes from the mitochondrion: it is the powerhouse that produces it.",
    "france.txt": "The capital of France is Paris, a city on the river Seine.",
}
GOLDEN_QUESTIONS = [
    (1, "Which city is the capital of France?", "Paris", "Paris, a city, is the capital of France.", ["france.txt"]),
    (2, "What produces ATP in a cell?", "ATP", "The mitochondrion produces ATP in a cell.", ["biology.txt"]),
    (3, "Who created the programming language Python?", "guido", "Guido van Rossum created the programming language Python.", ["python.txt"]),
    (4, "Which is the only natural satellite of Earth?", "moon", "The Moon is the only natural satellite of Earth.", ["space.txt"]),
    (5, "At how many Kelvin does mercury boil?", None, answer.NOT_FOUND, []),
]


def golden_run(engine: Engine, namespace: str = "golden") -> DataFrame:
    """Ingest the golden corpus into a fresh namespace and score its questions."""
    scope, spark = Scope(namespace), engine.spark
    rows = [(name, bytearray(text.encode()), None, n) for n, (name, text) in enumerate(sorted(GOLDEN_CORPUS.items()))]
    engine.purge(scope)
    engine.ingest(scope, spark.createDataFrame(rows, "source string, content binary, media_type string, ingest_seq long"))
    examples = spark.createDataFrame(GOLDEN_QUESTIONS, "query_id long, question string, expected string, truth string, relevant_sources array<string>")
    return engine.evaluate(scope, examples)
