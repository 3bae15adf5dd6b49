"""Index versions: signatures, change detection, atomic publication, refresh, status."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from .lexical import LexicalIndex, build_index, load_index, save_index

FORMAT_VERSION = 1
SIGNATURE_BUCKETS = 1024


def digests(docs: DataFrame) -> DataFrame:
    """document_id and content_hash of the documents that an index holds."""
    return docs.select(F.col("document_id").cast("string").alias("document_id"), F.coalesce("content_hash", F.lit("")).alias("content_hash"))


def corpus_signature(docs: DataFrame) -> DataFrame:
    """One row, signature: SHA-256 over "id\\nhash\\n" of all documents in the order of id (as text), then hash. The order of rows doesn't
    matter, any change does. A digest over all documents in order is one stream, which the last task joins; index versions are
    therefore told apart by bucketed_signature, which has no order."""
    pairs = digests(docs).agg(F.sort_array(F.collect_list(F.struct("document_id", "content_hash"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["document_id"], F.lit("\n"), x["content_hash"], F.lit("\n"))), "")
    return pairs.select(F.sha2(text, 256).alias("signature"))


def bucketed_signature(docs: DataFrame, buckets: int = SIGNATURE_BUCKETS) -> DataFrame:
    """Another signature with the same use, for any size: a sum over documents in each of a fixed number of buckets (commutative, so no
    order is needed), then SHA-256 over the buckets."""
    h = F.sha2(F.concat_ws("\n", "document_id", "content_hash"), 256)
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    rows = digests(docs).withColumn("h", h).groupBy(F.pmod(F.xxhash64("document_id"), F.lit(buckets)).alias("b")).agg(F.concat_ws(":", *[part(i).cast("string") for i in range(8)]).alias("s"), F.count("*").alias("n"))
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("b", "s", "n"))).alias("p"))
    return rows.select(F.sha2(F.to_json("p"), 256).alias("signature"))


def max_numeric_id(docs: DataFrame) -> DataFrame:
    """One row, max_document_id: the largest id that is a whole number, 0 without one."""
    return docs.agg(F.coalesce(F.max(F.col("document_id").try_cast("bigint")), F.lit(0)).cast("long").alias("max_document_id"))


def changes(stored: DataFrame, indexed: DataFrame) -> DataFrame:
    """document_id, change (new, modified, deleted) of those that differ between what is stored and what an index was made from."""
    left, right = digests(stored).withColumnRenamed("content_hash", "a"), digests(indexed).withColumnRenamed("content_hash", "b")
    kind = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return left.join(right, "document_id", "full_outer").select("document_id", kind.alias("change")).filter("change IS NOT NULL")


def is_stale(stored: DataFrame, indexed: DataFrame) -> bool:
    return not changes(stored, indexed).isEmpty()


#: What a folder may hold an index of: words or vectors.
KINDS = ("lexical", "semantic")


class IndexStore:
    """Versions of an index in a folder: each in a directory of its own, and a file, current, that names one of them and is put in the
    old one's place by one rename. A reader sees the old version or the new one, never a part; a failed build leaves the old one.
    The version before the current one stays, for readers that have it open; older ones go.

    A lexical store holds a LexicalIndex of documents (document_id, content, content_hash); a semantic one vectors of documents with
    an embedding besides.
    """

    def __init__(self, spark: SparkSession, folder: str, config: EngineConfig = DEFAULT, kind: str = "lexical") -> None:
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}: {kind}")
        self.spark, self.folder, self.config, self.kind = spark, folder.rstrip("/"), config, kind
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        self._fs = self._path().getFileSystem(conf)
        self._context = lambda: jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), conf)
        self._over = getattr(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), "OVERWRITE")

    def manifest(self) -> dict | None:
        """What the current version was made from; None if there is none, or none of this format and kind that is whole."""
        try:
            found = json.loads(self.spark.read.text(f"{self.folder}/current").first().value)
        except (AnalysisException, AttributeError, ValueError):
            return None
        parts = {"lexical": ("postings", "doc_stats", "term_stats", "stats"), "semantic": ("vectors",)}[self.kind]
        same = found.get("format_version") == FORMAT_VERSION and found.get("kind") == self.kind
        return found if same and all(self._fs.exists(self._path(f"{found.get('version', '')}/{x}/_SUCCESS")) for x in ("digests", *parts)) else None

    def rebuild(self, docs: DataFrame) -> dict:
        """Builds from documents, then publishes."""
        version, before = f"v-{uuid.uuid4().hex}", self.manifest()
        place = f"{self.folder}/{version}"
        digests(docs).write.parquet(f"{place}/digests")
        if self.kind == "lexical":
            save_index(build_index(docs, self.config), place)
        else:
            docs.filter("embedding IS NOT NULL").select("document_id", "embedding").write.parquet(f"{place}/vectors")
        made = self.spark.read.parquet(f"{place}/digests")
        found = {
            "format_version": FORMAT_VERSION,
            "kind": self.kind,
            "index_version": (before or {}).get("index_version", 0) + 1,
            "version": version,
            "previous": (before or {}).get("version"),
            "created_at": datetime.now(UTC).isoformat(),
            "document_count": made.count(),
            "max_document_id": max_numeric_id(made).first()[0],
            "corpus_hash": bucketed_signature(made).first()[0],
        }
        if self.kind == "semantic":
            found["dimension"] = self.spark.read.parquet(f"{place}/vectors").select(F.max(F.size("embedding"))).first()[0]
        self._publish(version, json.dumps(found))
        if before and before.get("previous"):
            self._fs.delete(self._path(before["previous"]), True)
        return found

    def _publish(self, version: str, text: str) -> None:
        out = self._fs.create(self._path(f"{version}.next"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self._context().rename(self._path(f"{version}.next"), self._path("current"), self._options())

    def _options(self):
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = self._over
        return options

    def indexed(self) -> DataFrame:
        """The documents that the current version holds: document_id and content_hash."""
        return self.spark.read.schema("document_id string, content_hash string").parquet(f"{self.folder}/{self.manifest()['version']}/digests")

    def load(self, docs: DataFrame | None = None) -> LexicalIndex | DataFrame | None:
        """The current version: an index, or vectors (document_id, embedding). None without one, or one whose documents aren't as many as
        it says or, where docs are given, aren't these."""
        found = self.manifest()
        if not found or self.indexed().count() != found["document_count"]:
            return None
        if docs is not None and bucketed_signature(docs).first()[0] != found["corpus_hash"]:
            return None
        place = f"{self.folder}/{found['version']}"
        return load_index(self.spark, place, self.config) if self.kind == "lexical" else self.spark.read.parquet(f"{place}/vectors")

    def load_or_rebuild(self, docs: DataFrame) -> LexicalIndex | DataFrame:
        """What a start does: the current version if it is valid for docs, else a new one."""
        loaded = self.load(docs)
        if loaded is None:
            self.rebuild(docs)
            loaded = self.load()
        return loaded

    def refresh(self, docs: DataFrame) -> dict:
        """Rebuilds only if documents changed: {"rebuilt", "new", "modified", "deleted"}."""
        if not self.manifest():
            self.rebuild(docs)
            return {"rebuilt": True, "new": docs.count(), "modified": 0, "deleted": 0}
        counted = {r.change: r["count"] for r in changes(docs, self.indexed()).groupBy("change").count().collect()}
        if counted:
            self.rebuild(docs)
        return {"rebuilt": bool(counted)} | {k: counted.get(k, 0) for k in ("new", "modified", "deleted")}

    def status(self, docs: DataFrame | None = None) -> dict:
        found = self.manifest()
        if not found:
            return {"status": "not_built", "documents": 0}
        stale = docs is not None and is_stale(docs, self.indexed())
        more = {"dimension": found["dimension"]} if self.kind == "semantic" else {}
        return {"status": "stale" if stale else "ready", "documents": found["document_count"], "index_version": found["index_version"]} | more

    def remove(self) -> None:
        found = self.manifest() or {}
        for name in ("current", found.get("version"), found.get("previous")):
            if name:
                self._fs.delete(self._path(name), True)


def rebuild_with_fallback(store: IndexStore, read_documents, local: DataFrame, crawled: DataFrame | None = None) -> dict:
    """Rebuilds from what read_documents() gives and publishes; where that can't be read, builds an index of the local documents and the crawled ones
    (document_id, content, content_hash each) and leaves the published version as it is. {"source": "database" or "legacy_corpus", "documents_indexed",
    "crawled_documents", "corpus_documents", "index_version", "index"}."""
    try:
        docs = read_documents()
        found = store.rebuild(docs)
        return {"source": "database", "documents_indexed": found["document_count"], "crawled_documents": None, "corpus_documents": None, "index_version": found["index_version"], "index": store.load()}
    except (PySparkException, Py4JJavaError, OSError):
        columns = ["document_id", "content", "content_hash"]
        docs = local.select(*columns) if crawled is None else local.select(*columns).unionByName(crawled.select(*columns))
        index = build_index(docs, store.config)
        indexed = index.doc_stats.count()
        more = 0 if crawled is None else index.doc_stats.join(crawled.select("document_id"), "document_id", "left_semi").count()
        return {"source": "legacy_corpus", "documents_indexed": indexed, "crawled_documents": more, "corpus_documents": indexed - more, "index_version": None, "index": index}
