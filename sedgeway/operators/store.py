"""Namespaced Parquet tables: upsert by document, delete, purge, lookup, snapshots.

The rows of a namespace lie in buckets by document.  A change writes the buckets it touches anew,
beside the old ones, and then one manifest that names the folder of every bucket of every table: who
reads sees all of a change or nothing of it, and two writers can't both win.  Isolation is the
application's: the only way in takes a :class:`~sedgeway.config.Scope`.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeway.config import Scope, WarehouseConfig, safe_identifier

CHUNKS = (
    "namespace string, chunk_id string, document_id string, text string, embed_text string, page int, ordinal int, "
    "embedding array<double>, embedding_model string, headings array<string>, metadata map<string,string>"
)
DOCUMENTS = "namespace string, document_id string, source string, content_hash string, ingest_seq long"


class SchemaMismatch(ValueError):
    """The stored vectors have another width than the configured one."""


def replaced(existing: DataFrame, incoming: DataFrame, documents: DataFrame, keys: tuple[str, ...] = ("namespace", "document_id")) -> DataFrame:
    """Rows after the incoming documents' old rows are gone and their new ones are in, however many they are now."""
    return existing.join(documents.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming)


def without(existing: DataFrame, documents: DataFrame, keys: tuple[str, ...] = ("namespace", "document_id")) -> DataFrame:
    """Rows of other documents."""
    return existing.join(documents.select(*keys).distinct(), list(keys), "left_anti")


class Conflict(RuntimeError):
    """Another writer changed the namespace in between; read again and retry."""


class Store:
    """The tables of a warehouse, seen through a scope."""

    def __init__(self, spark: SparkSession, config: WarehouseConfig) -> None:
        self.spark, self.config = spark, config
        self._open: tuple[str, dict[str, dict[str, str]]] | None = None

    def _base(self, namespace: str | None = None) -> str:
        base = f"{self.config.path.rstrip('/')}/{self.config.prefix}_tables"
        return base if namespace is None else f"{base}/namespace={_escaped(namespace)}"

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self._files(path)
        return fs.exists(p)

    def _manifest(self, namespace: str) -> tuple[int, dict[str, dict[str, str]]]:
        """Number and content of the newest manifest (or of the change that is open): table, bucket, folder."""
        if self._open is not None and self._open[0] == namespace:
            return -1, self._open[1]
        p, fs = self._files(f"{self._base(namespace)}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        numbers = [int(n[:-5]) for n in names if n.endswith(".json")]
        if not numbers:
            return 0, {t: {} for t in SCHEMAS}
        stream = fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(p, f"{max(numbers):012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return max(numbers), json.loads(text)

    def _publish(self, namespace: str, after: int, content: dict[str, dict[str, str]]) -> None:
        """Write the manifest that follows number ``after``; folders that neither it nor that one names go."""
        base = f"{self._base(namespace)}/manifests"
        draft, fs = self._files(f"{base}/.{uuid.uuid4().hex}")
        fs.mkdirs(draft.getParent())
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        final, _ = self._files(f"{base}/{after + 1:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(namespace)
        named = {folder for buckets in content.values() for folder in buckets.values()}
        if after > 1:  # the one before ``after`` is nobody's any more
            old, _ = self._files(f"{base}/{after - 1:012d}.json")
            if fs.exists(old):
                current = {f for t in self._read_json(f"{base}/{after:012d}.json").values() for f in t.values()}
                for folder in {f for t in self._read_json(str(old.toString())).values() for f in t.values()} - named - current:
                    fs.delete(self._files(folder)[0], True)
                fs.delete(old, False)

    def _read_json(self, path: str) -> dict:
        p, fs = self._files(path)
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("document_id"), F.lit(self.config.buckets)).cast("int")

    def _rows(self, table: str, namespace: str, folders: list[str]) -> DataFrame:
        schema = SCHEMAS[table]
        if not folders:
            return self.spark.createDataFrame([], schema)
        bare = schema.replace("namespace string, ", "", 1)
        rows = self.spark.read.schema(bare).parquet(*folders).withColumn("namespace", F.lit(namespace))
        return rows.select(*[c.split()[0] for c in schema.split(", ")])

    def read(self, table: str, scope: Scope | None) -> DataFrame:
        """Rows of the scope's namespace, narrowed to its documents; without a scope, none."""
        if scope is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        rows = self._rows(table, scope.namespace, sorted(set(self._manifest(scope.namespace)[1].get(table, {}).values())))
        ids = scope.document_ids()
        return rows if ids is None else rows.where(F.col("document_id").isin(ids) if ids else F.lit(False))

    @contextmanager
    def changing(self, scope: Scope) -> Iterator[Store]:
        """Several changes of one namespace that are seen together: published at the end, or not at all if the block fails.

        Inside, this store reads what it has written.
        """
        if self._open is not None:
            raise RuntimeError("a change is open")
        number, content = self._manifest(scope.namespace)
        self._open = (scope.namespace, content)
        try:
            yield self
            if self._open[1] is not content:
                after, self._open = self._open[1], None
                self._publish(scope.namespace, number, after)
        finally:
            self._open = None

    def _change(self, scope: Scope, buckets: list[int], change: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
        """Write these buckets of the tables anew and publish them together."""
        number, content = self._manifest(scope.namespace)
        content = {t: dict(content.get(t, {})) for t in SCHEMAS}
        for table, to in change.items():
            old = [content[table][str(b)] for b in buckets if str(b) in content[table]]
            fresh = f"{self._base(scope.namespace)}/{table}-{uuid.uuid4().hex}"
            rows = to(self._rows(table, scope.namespace, old)).drop("namespace").withColumn("bucket", self._bucket())
            rows.repartition(F.col("bucket")).write.partitionBy("bucket").parquet(fresh)
            p, fs = self._files(fresh)
            written = {f.getPath().getName().split("=")[1] for f in fs.listStatus(p) if f.getPath().getName().startswith("bucket=")}
            for b in map(str, buckets):
                content[table].pop(b, None)
                if b in written:
                    content[table][b] = f"{fresh}/bucket={b}"
        if self._open is not None and self._open[0] == scope.namespace:
            self._open = (scope.namespace, content)
        else:
            self._publish(scope.namespace, number, content)

    def migrate(self) -> None:
        """Make the folder; first make sure that what is stored has the configured width."""
        width = self.stored_width()
        if width is not None and width != self.config.embedding_width:
            raise SchemaMismatch(f"stored width {width}, configured {self.config.embedding_width}")
        p, fs = self._files(self._base())
        fs.mkdirs(p)

    def namespaces(self) -> list[str]:
        p, fs = self._files(self._base())
        found = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(_unescaped(n.split("=", 1)[1]) for n in found if n.startswith("namespace="))

    def stored_width(self) -> int | None:
        """Width of the stored vectors; None where there are none."""
        for namespace in self.namespaces():
            row = self.read("chunks", Scope(namespace)).where("size(embedding) > 0").select(F.size("embedding").alias("w")).first()
            if row:
                return row["w"]
        return None

    def ddl(self) -> list[str]:
        """Statements, in order, that declare a namespace's tables to a catalog as views of their current rows."""
        out = [f"CREATE DATABASE IF NOT EXISTS {self.config.prefix}"]
        for namespace in self.namespaces():
            for table in SCHEMAS:
                folders = sorted(set(self._manifest(namespace)[1].get(table, {}).values()))
                columns = ", ".join(c.split()[0] for c in SCHEMAS[table].split(", ") if not c.startswith("namespace"))
                name = safe_identifier(f"{re.sub('[^A-Za-z0-9_]', '_', namespace)}_{table}")
                parts = " UNION ALL ".join(f"SELECT {columns} FROM parquet.`{f}`" for f in folders)
                if parts:
                    out.append(f"CREATE OR REPLACE VIEW {self.config.prefix}.{name} AS {parts}")
        return out

    def upsert(self, scope: Scope, documents: DataFrame, chunks: DataFrame) -> None:
        """Replace these documents and all their chunks. Rows of another namespace are refused."""
        for rows in (documents, chunks):
            if rows.where(F.col("namespace").isNull() | (F.col("namespace") != scope.namespace)).take(1):
                raise ValueError("rows of another namespace")
        if chunks.where("embedding is not null and coalesce(embedding_model, '') = ''").take(1):
            raise ValueError("an embedding needs the name of its model")
        if chunks.where(f"embedding is not null and size(embedding) <> {self.config.embedding_width}").take(1):
            raise SchemaMismatch(f"vectors must be {self.config.embedding_width} wide")
        buckets = [r["b"] for r in documents.select(self._bucket().alias("b")).distinct().collect()]  # config.buckets at most
        if buckets:
            self._change(scope, buckets, {"chunks": lambda old: replaced(old, chunks, documents), "documents": lambda old: replaced(old, documents, documents)})

    def delete_document(self, scope: Scope, document_id: str) -> None:
        """Remove a document everywhere; unknown ones and unknown namespaces are no error."""
        bucket = self.spark.createDataFrame([(document_id,)], "document_id string").select(self._bucket()).first()[0]
        content = self._manifest(scope.namespace)[1]
        if any(str(bucket) in t for t in content.values()):
            keep = lambda old: old.where(F.col("document_id") != document_id)
            self._change(scope, [bucket], dict.fromkeys(SCHEMAS, keep))

    def purge(self, scope: Scope) -> None:
        """Drop all of the namespace."""
        p, fs = self._files(self._base(scope.namespace))
        fs.delete(p, True)

    def get(self, scope: Scope, document_id: str) -> DataFrame:
        """The document's row, if the scope lets it through."""
        return self.read("documents", scope).where(F.col("document_id") == document_id)

    def snapshot(self, scope: Scope, path: str) -> None:
        """A copy of the namespace's tables in a folder, for :meth:`restore`."""
        for table in SCHEMAS:
            self.read(table, Scope(scope.namespace)).drop("namespace").write.mode("overwrite").parquet(f"{path.rstrip('/')}/{table}")

    def restore(self, scope: Scope, path: str) -> None:
        """Make the namespace what a snapshot holds, whichever namespace that was taken of."""
        rows = {t: self.spark.read.schema(SCHEMAS[t].replace("namespace string, ", "", 1)).parquet(f"{path.rstrip('/')}/{t}").withColumn("namespace", F.lit(scope.namespace)) for t in SCHEMAS}
        self._change(scope, list(range(self.config.buckets)), {t: lambda old, t=t: rows[t].select(old.columns) for t in SCHEMAS})

    def find_by_hash(self, scope: Scope, content_hash: str) -> DataFrame:
        return self.read("documents", scope).where(F.col("content_hash") == content_hash)

    def postings(self, scope: Scope) -> DataFrame:
        """``token, chunk_id, tf`` of the scope's chunks, derived and never stale."""
        from sedgeway.functions.text import tokens

        return self.read("chunks", scope).select("chunk_id", F.explode(tokens(F.col("embed_text"))).alias("token")).groupBy("token", "chunk_id").agg(F.count("*").alias("tf"))

    def ping(self) -> bool:
        """Whether the session answers; never raises."""
        try:
            return self.spark.sql("SELECT 1").first()[0] == 1
        except Exception:
            return False


SCHEMAS = {"chunks": CHUNKS, "documents": DOCUMENTS}


def _unescaped(name: str) -> str:
    return re.sub("%([0-9A-F]{4,6});", lambda m: chr(int(m[1], 16)), name)


def _escaped(namespace: str) -> str:
    return "".join(c if c.isalnum() or c in "-_" else f"%{ord(c):04X};" for c in namespace)
