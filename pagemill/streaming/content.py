"""Incremental extraction with Structured Streaming.

The URLs that were handled are operator state, kept in RocksDB, so a batch looks up its own URLs only and its cost does not
grow with what came before.  Each micro-batch is then the batch job.  It writes to its own folders,
replaces them when replayed, and counts as done once its totals are written, which comes last: a
restart adds nothing twice, and readers see whole batches only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators.joins import skew_safe_join
from pagemill.operators.models import parse_selectors, selectors_for_pages, selectors_per_type
from pagemill.operators.records import RECORD_FIELDS, content_records
from pagemill.sinks.writers import write_content_jsonl
from pagemill.sources.pages import PAGES_SCHEMA

_CONTENT_SCHEMA = (
    "url string, page_type string, title string, description string, author string, date string, "
    "headings array<string>, main_content string, nav_links array<string>, sidebar_sections array<string>, "
    "footer string, batch_id int"
)
_STATE_SCHEMA = "visited_count long, extracted_count long, batch_id long"
_SETS_SCHEMA = "page_type string, selectors map<string,string>, batch_id long"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Lookup = DataFrame | Callable[[DataFrame], DataFrame]


def page_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Pages from a folder that grows by whole files."""
    reader = spark.readStream.schema(PAGES_SCHEMA).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_dedupe(pages: DataFrame, forget_after: str | None = None) -> DataFrame:
    """A URL passes once: one of its pages, the others are dropped.

    The state holds the URLs in RocksDB on the executors' disks.  With ``forget_after`` (such as ``30 days``) a URL is forgotten that
    long after it passed, by the clock, and the state is as large as the URLs of that time; else it grows with
    the distinct URLs.
    """
    pages.sparkSession.conf.set(_STORE, _ROCKSDB)
    if forget_after is None:
        return pages.dropDuplicates(["url"])
    timed = pages.withColumn("_passed_at", F.current_timestamp()).withWatermark("_passed_at", forget_after)
    return timed.dropDuplicatesWithinWatermark(["url"]).drop("_passed_at")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _for(batch: DataFrame, lookup: Lookup | None) -> DataFrame | None:
    return lookup(batch) if callable(lookup) else lookup


def _totals(spark: SparkSession, out: str, batch_id: int) -> tuple[int, int]:
    """(visited, extracted) after the batch before this one; only its own file is read."""
    path = f"{out}/state/batch_id={batch_id - 1}"
    if batch_id == 0 or not _exists(spark, path):
        return 0, 0
    return tuple(spark.read.schema("visited_count long, extracted_count long").json(path).first())


def _batch_selectors(fresh: DataFrame, replies: DataFrame, out: str, batch_id: int) -> DataFrame:
    """``(page_id, selectors)``: a type's first readable set, of this or an earlier batch, holds from then on.

    ``replies`` is ``(page_id, page_type, order_key, raw)``; ``sets`` has one row for each page type that ever had a set.
    """
    spark = fresh.sparkSession
    parsed = parse_selectors(replies)
    known = spark.createDataFrame([], _SETS_SCHEMA)
    if _exists(spark, f"{out}/sets"):
        known = spark.read.schema(_SETS_SCHEMA).parquet(f"{out}/sets").where(F.col("batch_id") < batch_id)
    known = known.select("page_type", F.col("selectors").alias("_known"))
    new = selectors_per_type(parsed).select("page_type", "selectors").join(known, "page_type", "left_anti")
    new.write.mode("overwrite").parquet(f"{out}/sets/batch_id={batch_id}")
    own = selectors_for_pages(parsed).select("page_id", "page_type", "selectors")
    joined = skew_safe_join(own, known, "page_type", "left")
    return joined.select("page_id", F.coalesce("_known", "selectors").alias("selectors"))


def stream_content(
    pages: DataFrame,
    out: str,
    checkpoint: str,
    once: bool = True,
    analysis: Lookup | None = None,
    selector_replies: Lookup | None = None,
    page_types: tuple[str, ...] | None = None,
    forget_after: str | None = None,
) -> StreamingQuery:
    """Extract content records from a page stream, each URL once.

    Writes below ``out``, by batch: ``content`` (JSON lines), ``visited`` (URLs), ``sets`` (first readable selector set of each page
    type, if there are replies) and last ``state`` (running totals), with which a batch is done.  ``analysis`` is
    ``(url, page_type)``, ``selector_replies`` is ``(page_id, page_type, order_key, raw)``: a table, or a function from a batch
    of pages to one, such as a model.  ``page_types`` are the types to keep.  ``once`` handles what is there and
    stops; else the query keeps running.
    """

    def handle(fresh: DataFrame, batch_id: int) -> None:
        spark = fresh.sparkSession
        mine = f"batch_id={batch_id}"
        fresh = fresh.persist()  # read by several writes; the state behind it must not run again for each
        try:
            replies = _for(fresh, selector_replies)
            selectors = None if replies is None else _batch_selectors(fresh, replies, out, batch_id)
            fresh.select("url").write.mode("overwrite").parquet(f"{out}/visited/{mine}")
            records = content_records(fresh, _for(fresh, analysis), selectors, page_types)
            write_content_jsonl(records, f"{out}/content/{mine}")
        finally:
            fresh.unpersist()
        visited, extracted = _totals(spark, out, batch_id)
        visited += spark.read.parquet(f"{out}/visited/{mine}").count()
        extracted += spark.read.text(f"{out}/content/{mine}").count()
        state = spark.range(1).select(F.lit(visited).alias("visited_count"), F.lit(extracted).alias("extracted_count"))
        state.write.mode("overwrite").json(f"{out}/state/{mine}")

    writer = stream_dedupe(pages, forget_after).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _done(spark: SparkSession, out: str) -> int:
    """The last batch that is done, -1 if there is none."""
    if not _exists(spark, f"{out}/state"):
        return -1
    last = read_state(spark, out).agg(F.max("batch_id")).first()[0]
    return -1 if last is None else last


def read_content(spark: SparkSession, out: str) -> DataFrame:
    """The content records of all batches that are done, with ``extra``: their further fields as a map."""
    if not _exists(spark, f"{out}/content"):
        return spark.createDataFrame([], f"{_CONTENT_SCHEMA}, extra map<string,string>")
    lines = spark.read.schema("value string, batch_id int").text(f"{out}/content").where(F.col("batch_id") <= _done(spark, out))
    known = F.from_json("value", _CONTENT_SCHEMA.rsplit(",", 1)[0]).alias("r")
    more = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: ~k.isin(RECORD_FIELDS))
    return lines.select(known, "batch_id", F.when(F.size(more) > 0, more).alias("extra")).select("r.*", "batch_id", "extra")


def read_state(spark: SparkSession, out: str) -> DataFrame:
    """Running totals after each batch."""
    return spark.read.schema(_STATE_SCHEMA).json(f"{out}/state")
