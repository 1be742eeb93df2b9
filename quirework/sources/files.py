"""Readers and append-only writers for uploads, jobs, spans and page results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.settle import settle

MAX_BYTES = 100 * 1024 * 1024
UPLOADS = (
    "upload_id string, original_filename string, stored_filename string, size_bytes bigint, mime_type string, "
    "uploaded_at string, status string"
)
JOBS = (
    "job_id string, upload_id string, status string, progress int, current_stage string, created_at string, "
    "updated_at string, pipeline array<struct<agent:string,status:string>>, ocr_strategy string, error string, "
    "document_id string, _corrupt string"
)
SPANS = (
    "doc_id string, page_number int, block_ord int, line_ord int, span_ord int, text string, size double, font string, "
    "flags int, bx0 double, by0 double, bx1 double, by1 double"
)
BUCKETS = 1024


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def screen_uploads(files: DataFrame) -> DataFrame:
    """Accept PDF uploads; the first broken rule is the reason.

    ``files``: file_name, mime_type, content (or head) and length.
    """
    rules = (
        ("coalesce(file_name, '') = ''", "NO_FILE"),
        ("NOT endswith(lower(file_name), '.pdf')", "EXTENSION"),
        ("NOT (mime_type <=> 'application/pdf')", "MIME_TYPE"),
        ("length = 0", "EMPTY"),
        ("NOT (substring(content, 1, 5) <=> CAST('%PDF-' AS BINARY))", "SIGNATURE"),
        (f"length > {MAX_BYTES}", "TOO_LARGE"),
    )
    reason = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in rules) + " END"
    return files.withColumn("reject_reason", F.expr(reason)).withColumn("accepted", F.col("reject_reason").isNull()).drop("content")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(UPLOADS).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job files, corrupt ones skipped, newest first."""
    df = spark.read.schema(JOBS).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    required = "_corrupt IS NULL AND job_id IS NOT NULL AND status IS NOT NULL"
    return df.where(required).drop("_corrupt").orderBy(F.desc("created_at"))


def read_spans(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(SPANS).format(fmt).load(path)


def explode_spans(pages: DataFrame) -> DataFrame:
    """Flat span rows from nested page rows (blocks, then lines, then spans)."""
    b = pages.select("doc_id", "page_number", F.posexplode("blocks").alias("block_ord", "b"))
    ln = b.select("doc_id", "page_number", "block_ord", "b.bx0", "b.by0", "b.bx1", "b.by1", F.posexplode("b.lines").alias("line_ord", "l"))
    return ln.select("doc_id", "page_number", "block_ord", "line_ord", "bx0", "by0", "bx1", "by1",
                     F.posexplode("l.spans").alias("span_ord", "s")).select(
        "doc_id", "page_number", "block_ord", "line_ord", "span_ord", "s.text", "s.size", "s.font", "s.flags",
        "bx0", "by0", "bx1", "by1")


def attach_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Page size on every block, joined on (document, page)."""
    side = pages.select("doc_id", "page_number", F.col("width").alias("page_width"), F.col("height").alias("page_height"))
    return blocks.join(side, ["doc_id", "page_number"], "left")


def bucketed(df: DataFrame, doc: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int"))


def write_table(df: DataFrame, path: str, doc: str = "doc_id", buckets: int = BUCKETS) -> None:
    """Append a document table, partitioned by document bucket so that point reads prune."""
    out = bucketed(df, doc, buckets).hint("rebalance", "bucket")  # few files per bucket, large buckets split
    out.write.mode("append").partitionBy("bucket").parquet(path)


def read_table(spark: SparkSession, path: str, doc_id=None, doc: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """A document table; with ``doc_id`` only its bucket is scanned."""
    df = spark.read.parquet(path)
    if doc_id is not None:
        value = F.lit(doc_id).cast(df.schema[doc].dataType)
        df = df.where((F.col("bucket") == F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")) & (F.col(doc) == value))
    return df.drop("bucket")


def append_only(new: DataFrame, existing: DataFrame | None, path: str, keys: list[str]) -> DataFrame:
    """Append rows whose key is not stored yet; stored rows are never rewritten.  Returns the appended rows."""
    fresh = new.dropDuplicates(keys)
    if existing is not None:
        fresh = fresh.join(existing.select(*keys), keys, "left_anti")
    # Settled first: what is returned is what was written, though the table has changed since.
    fresh = settle(fresh)
    fresh.write.mode("append").parquet(path)
    return fresh


def page_hash(pages: DataFrame) -> DataFrame:
    """Digest of page content and size: equal pages are recognised once."""
    return pages.withColumn("page_hash", F.expr("sha2(concat(content, CAST(rect AS BINARY)), 256)"))


def page_work(pages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct pages still to recognise, pages served from the cache).

    Which pages those are is decided on digests and keys; content moves only for them.
    """
    hashed = page_hash(pages)
    keys = [c for c in pages.columns if c not in ("content", "rect")]
    narrow = hashed.select("page_hash", *keys)
    first = narrow.join(cache.select("page_hash"), "page_hash", "left_anti").groupBy("page_hash").agg(F.min(F.struct(*keys)).alias("k"))
    work = hashed.join(first.select("page_hash", *[F.col(f"k.{c}").alias(c) for c in keys]), ["page_hash", *keys], "left_semi")
    return work.dropDuplicates(["page_hash"]), narrow.join(cache, "page_hash")
