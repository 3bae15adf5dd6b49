"""Document sources and sinks: markdown trees, stored rows, crawled pages, judgements, hash-deduplicated appends."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: File names that aren't documents, in any case.
NOT_DOCUMENTS = ("index.md", "readme.md", "manifest.md")


def read_markdown(spark: SparkSession, folder: str, dedupe: bool = True) -> DataFrame:
    """Documents from all *.md files below folder: document_id, title, content, source, content_hash, tokens.

    The title is that of the front matter, else the file's name; the front matter isn't content. Empty files go, and with dedupe all but
    the first (by path) of equal folded contents, and then those without tokens. A missing folder has no documents.
    """
    try:
        files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    except AnalysisException:
        files = spark.createDataFrame([], "value string").withColumn("_metadata", F.struct(F.lit("").alias("file_path")))
    files = files.select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("path"))
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    files = files.withColumn("name", F.call_function("url_decode", F.replace(name, F.lit("+"), F.lit("%2B")))).filter(~F.lower("name").isin(*NOT_DOCUMENTS))
    stem = F.regexp_replace("name", r"\.md\z", "")
    front = F.regexp_extract("raw", r"(?s)(?m:^---\s*$)(.*?)(?:(?m:^---\s*$)|\z)", 1)
    title = F.regexp_replace(F.trim(F.regexp_extract(front, r"(?mi)^title\s*:[ \t]*(.*)$", 1)), r"\A['\"]+|['\"]+\z", "")
    content = T.strip(F.regexp_replace("raw", r"(?s)\A---[ \t]*\r?\n(?:.*?\n)??---[ \t]*(?:\r?\n|\z)", ""))
    rows = files.select(
        stem.alias("document_id"),
        F.coalesce(F.nullif(title, F.lit("")), F.initcap(F.replace(stem, F.lit("_"), F.lit(" ")))).alias("title"),
        content.alias("content"),
        F.col("path").alias("source"),
    ).filter("content <> ''")
    rows = rows.withColumn("content_hash", F.sha2(T.fold(F.col("content")), 256))
    if dedupe:
        rows = keep_first(rows, ["content_hash"], ["source"])
    return rows.withColumn("tokens", T.tokens(F.col("content"))).filter(F.size("tokens") > 0)


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; the others go."""
    first = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__n", first).filter("__n = 1").drop("__n")


def documents(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Stored rows as documents: document_id, title (first line), content (stripped), source. Null texts are empty."""
    content = T.strip(F.coalesce(F.col(text_col), F.lit("")))
    return rows.select(F.col(id_col).alias("document_id"), T.title_of(content).alias("title"), content.alias("content"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))


def scan(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Stored documents in the order of document_id, the first limit of them if there is one (a negative one is none at all). With a limit Spark keeps so
    many rows of each partition and no more; without one the order is that of a range partitioning."""
    return rows.orderBy("document_id") if limit is None else rows.orderBy("document_id").limit(max(0, limit))


def read_database(spark: SparkSession, url: str, table: str = "documents", number: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table of a database by JDBC. number is a column of whole numbers whose range is split over partitions, so that each is read by a
    query of its own; its bounds are asked for first. Filters, columns and limits go to the database."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if number:
        low, high = reader.option("query", f"SELECT MIN({number}) AS low, MAX({number}) AS high FROM {table}").load().first()
        if low is not None:
            reader = spark.read.format("jdbc").option("url", url).options(**options).option("partitionColumn", number).option("lowerBound", low).option("upperBound", high + 1).option("numPartitions", partitions)
        else:
            reader = spark.read.format("jdbc").option("url", url).options(**options)
    return reader.option("dbtable", table).load()


def indexable(docs: DataFrame, include_crawled: bool = True) -> DataFrame:
    """Documents that an index holds: those with tokens, on demand without crawled ones (http or https sources)."""
    if not include_crawled:
        docs = docs.filter(~F.col("source").rlike("^https?://"))
    return docs.withColumn("tokens", T.tokens(F.col("content"))).filter(F.size("tokens") > 0)


def crawl_documents(pages: DataFrame) -> DataFrame:
    """Crawled pages (url, title, text, content_hash) as documents; the id comes from the hash, a missing title is the url."""
    return pages.select(
        F.concat(F.lit("crawl-"), F.substring("content_hash", 1, 12)).alias("document_id"),
        F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("url")).alias("title"),
        F.col("text").alias("content"),
        F.col("url").alias("source"),
        "content_hash",
    ).filter(F.size(T.tokens(F.col("content"))) > 0)


def union_sources(*sources: DataFrame) -> DataFrame:
    """Corpus and extra documents together, without those that have no content or tokens."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.filter((F.coalesce("content", F.lit("")) != "") & (F.size(T.tokens(F.col("content"))) > 0))


def new_only(rows: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """What an insert-if-absent appends: rows whose content_hash isn't stored, the first of each."""
    return keep_first(rows.join(stored.select("content_hash"), "content_hash", "left_anti"), ["content_hash"], order)


def by_hash(docs: DataFrame, content_hash: str) -> DataFrame:
    """The document with a content; of several the one with the smallest id."""
    return docs.filter(F.col("content_hash") == content_hash).orderBy("document_id").limit(1)


def by_id(docs: DataFrame, document_id) -> DataFrame:
    return docs.filter(F.col("document_id") == F.lit(document_id)).limit(1)


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of {query, relevance: {document: grade}} as rows query, document_id, grade."""
    cases = spark.read.schema("query string, relevance map<string,int>").json(path, multiLine=True)
    return cases.filter("query IS NOT NULL").select("query", F.explode("relevance").alias("document_id", "grade")).filter("grade >= 0")


def crawled_counts(docs: DataFrame) -> DataFrame:
    """One row: documents, crawled (http or https sources), corpus."""
    crawled = F.col("source").rlike("^https?://")
    return docs.agg(F.count("*").alias("documents"), F.count_if(crawled).alias("crawled"), F.count_if(~F.coalesce(crawled, F.lit(False))).alias("corpus"))
