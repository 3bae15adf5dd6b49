"""A lexical index in segments: a change writes the postings of the documents that changed and nothing else.

A version is a list of segments and of tombstones. A segment holds postings, documents and document frequencies; a tombstone says that a
segment's document counts no more, and comes with what that takes from the frequencies. A version is read as all segments without what has a
tombstone, and gives the scores that an index built anew gives. Versions are published by one rename; merging puts small segments together.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..sources.tables import stored
from .lexical import LexicalIndex, corpus_totals, counted, inlined, with_idf
from .lifecycle import IndexStore

POSTINGS = "term string, document_id {id}, tf long, dl long"


class SegmentStore:
    """Segments in a folder, for documents (document_id, content, content_hash) whose ids name them. Ids are of one type for all time. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, config: EngineConfig = DEFAULT) -> None:
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config
        self._store = IndexStore(spark, f"{self.folder}/versions", config)

    def manifest(self) -> dict:
        """The current version: segments and tombstones by name, and the one before. An empty one if there is none yet."""
        if not self._store._fs.exists(self._store._path("current")):
            return {"version": 0, "segments": [], "tombstones": [], "id_type": None, "before": None}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/versions/current").collect()))

    def _publish(self, found: dict, **new) -> dict:
        before = {k: found[k] for k in ("segments", "tombstones")}
        made = found | new | {"version": found["version"] + 1, "before": before}
        self._store._publish(f"v-{made['version']}", json.dumps(made))
        return made

    def _read(self, part: str, names: list[str], schema: str) -> DataFrame:
        """Rows of some segments or tombstones, with segment where it isn't a column of theirs."""
        out = None
        for name in names:
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{part}")
            rows = rows if "segment " in schema else rows.withColumn("segment", F.lit(name))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            out = self.spark.createDataFrame([], schema if "segment " in schema else f"{schema}, segment string")
        return out

    def _gone(self, found: dict) -> DataFrame:
        return self._read("gone", found["tombstones"], f"segment string, document_id {found['id_type'] or 'string'}")

    def _live(self, found: dict, part: str, schema: str, segments: list[str] | None = None) -> DataFrame:
        rows = self._read(part, found["segments"] if segments is None else segments, schema.format(id=found["id_type"] or "string"))
        return rows.join(self._gone(found), ["segment", "document_id"], "left_anti") if found["tombstones"] else rows

    def documents(self, found: dict | None = None) -> DataFrame:
        """document_id, content_hash, dl and segment of what the current version holds, documents without tokens too (dl 0)."""
        return self._live(found or self.manifest(), "documents", "document_id {id}, content_hash string, dl long")

    def index(self) -> LexicalIndex:
        """The current version as an index. Frequencies are sums over segments and tombstones; postings are not counted again."""
        found = self.manifest()
        postings = self._live(found, "postings", POSTINGS).select("term", "document_id", "tf", "dl")
        doc_stats = self.documents(found).filter("dl > 0").select("document_id", "dl")
        stats = corpus_totals(doc_stats)
        df = self._read("frequencies", [*found["segments"], *found["tombstones"]], "segment string, term string, df long").join(self.spark.createDataFrame([(s,) for s in found["segments"]], "segment string"), "segment", "left_semi")
        df = df.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        return LexicalIndex(postings, doc_stats, with_idf(df, stats, self.config), stats, self.config)

    def _write(self, name: str, postings: DataFrame, documents: DataFrame) -> None:
        """A segment of postings (term, document_id, tf, dl) and documents (document_id, content_hash, dl), both read from stored rows."""
        place = f"{self.folder}/{name}"
        postings.repartitionByRange("term").sortWithinPartitions("term", "document_id").write.parquet(f"{place}/postings")
        documents.select("document_id", "content_hash", "dl").write.parquet(f"{place}/documents")
        made = self.spark.read.schema(postings.schema).parquet(f"{place}/postings")
        made.groupBy("term").agg(F.count("*").alias("df")).select(F.lit(name).alias("segment"), "term", "df").write.parquet(f"{place}/frequencies")

    def _bury(self, name: str, found: dict, gone: DataFrame) -> None:
        """Tombstones for gone (segment, document_id), with what they take from the frequencies: only those segments' postings are read."""
        place = f"{self.folder}/{name}"
        gone.select("segment", "document_id").write.parquet(f"{place}/gone")
        made = self.spark.read.schema(gone.select("segment", "document_id").schema).parquet(f"{place}/gone")
        touched = [r.segment for r in made.select("segment").distinct().collect()]
        lost = self._read("postings", touched, POSTINGS.format(id=found["id_type"] or "string")).join(made, ["segment", "document_id"], "left_semi")
        lost.groupBy("segment", "term").agg((-F.count("*")).cast("long").alias("df")).write.parquet(f"{place}/frequencies")

    def changes(self, docs: DataFrame) -> DataFrame:
        """document_id, change (new, modified, deleted) and segment (of the old one), between docs and the current version."""
        found = self.manifest()
        id_type = found["id_type"] or docs.schema["document_id"].dataType.simpleString()
        now = docs.select("document_id", F.coalesce("content_hash", F.lit("")).alias("a"))
        old = self.documents(found | {"id_type": id_type}).select("document_id", F.coalesce("content_hash", F.lit("")).alias("b"), "segment")
        kind = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
        return now.join(old, "document_id", "full_outer").select("document_id", kind.alias("change"), "segment").filter("change IS NOT NULL")

    def refresh(self, docs: DataFrame) -> dict:
        """Makes docs the current version's documents: {"changed", "new", "modified", "deleted", "segment"}. What is written is a segment of the new and modified
        documents and tombstones for the modified and deleted ones; without changes nothing is, and no version is made."""
        return self._apply(docs, self.changes(docs))

    def add(self, docs: DataFrame) -> dict:
        """Like refresh, but documents that docs doesn't have stay."""
        return self._apply(docs, self.changes(docs).filter("change <> 'deleted'"))

    def _apply(self, docs: DataFrame, changed: DataFrame) -> dict:
        found, name = self.manifest(), uuid.uuid4().hex
        found = found | {"id_type": found["id_type"] or docs.schema["document_id"].dataType.simpleString()}
        changed.write.parquet(f"{self.folder}/{name}/changes")
        changed = self.spark.read.schema(changed.schema).parquet(f"{self.folder}/{name}/changes")
        counts = dict.fromkeys(("new", "modified", "deleted"), 0) | {r.change: r["count"] for r in changed.groupBy("change").count().collect()}
        if not sum(counts.values()):
            self._store._fs.delete(self._store._path(f"../{name}"), True)
            return {"changed": False, **counts, "segment": None}
        segments, tombstones = list(found["segments"]), list(found["tombstones"])
        if counts["new"] + counts["modified"]:
            fresh = docs.join(changed.filter("change <> 'deleted'").select("document_id"), "document_id", "left_semi")
            # stored, as dealing postings by ranges reads them twice
            by_document = stored(counted(fresh, "content_hash"), "by-document")
            self._write(f"s-{name}", inlined(by_document), by_document)
            segments.append(f"s-{name}")
        if counts["modified"] + counts["deleted"]:
            self._bury(f"t-{name}", found, changed.filter("segment IS NOT NULL AND change <> 'new'"))
            tombstones.append(f"t-{name}")
        self._publish(found, segments=segments, tombstones=tombstones)
        return {"changed": True, **counts, "segment": f"s-{name}" if counts["new"] + counts["modified"] else None}

    def merge(self, most: int = 8) -> bool:
        """Puts the smallest segments together until there are at most that many; False if there is nothing to do. Tombstones whose segments are all
        gone by then go too."""
        found = self.manifest()
        if len(found["segments"]) <= most:
            return False
        sizes = {r.segment: r.n for r in self._read("documents", found["segments"], f"document_id {found['id_type']}, content_hash string, dl long").groupBy("segment").agg(F.count("*").alias("n")).collect()}
        small = sorted(found["segments"], key=lambda s: sizes.get(s, 0))[: len(found["segments"]) - most + 1]
        name = f"s-{uuid.uuid4().hex}"
        documents = self._live(found, "documents", "document_id {id}, content_hash string, dl long", small)
        self._write(name, self._live(found, "postings", POSTINGS, small).select("term", "document_id", "tf", "dl"), documents)
        segments = [s for s in found["segments"] if s not in small] + [name]
        used = {r.segment for r in self._gone(found).select("segment").distinct().collect()} & set(segments) if found["tombstones"] else set()
        tombstones = [t for t in found["tombstones"] if used & {r.segment for r in self._read("gone", [t], f"segment string, document_id {found['id_type']}").select("segment").distinct().collect()}]
        self._publish(found, segments=segments, tombstones=tombstones)
        return True

    def vacuum(self) -> int:
        """Deletes what neither the current version nor the one before it, which readers may have open, uses: the number of folders."""
        found = self.manifest()
        used = {*found["segments"], *found["tombstones"], *(found["before"] or {}).get("segments", []), *(found["before"] or {}).get("tombstones", []), "versions"}
        names = [s.getPath().getName() for s in self._store._fs.listStatus(self._store._path(".."))]
        gone = [n for n in names if n not in used]
        for n in gone:
            self._store._fs.delete(self._store._path(f"../{n}"), True)
        return len(gone)
