"""Incremental ingest as a structured stream: idempotent inserts, ids, and embedding upserts per micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.store import insert_ignore, surrogate_ids
from plumbline.session import Folder

CHUNK_SCHEMA = "id bigint, doc string, page int, ordinal int, text string"
INPUT_SCHEMA = "doc string, page int, ordinal int, text string"
#: Each batch is laid out by a hash of the manual, so that a later batch reads only what its manuals may lie in.
BUCKETS = 64


def _bucket(doc: Column) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(BUCKETS)).cast("int")


def stored_batches(spark: SparkSession, path: str) -> dict[int, int]:
    """{number: highest id so far} of the batches that were written whole, by their markers."""
    folder = Folder(spark, path)
    return {int(n[6:]): int(folder.read(f"{n}/_top")) for n in folder.names() if n.startswith("batch=") and folder.exists(f"{n}/_top")}


def _read(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    parts = [f"{path}/batch={n}" for n in numbers]
    rows = spark.read.schema(CHUNK_SCHEMA + ", bucket int").option("basePath", path)
    return rows.parquet(*parts) if parts else spark.createDataFrame([], CHUNK_SCHEMA + ", bucket int")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The chunk store's current rows; none before the first batch."""
    return _read(spark, path, sorted(stored_batches(spark, path))).select("id", "doc", "page", "ordinal", "text")


def ingest_batch(store_path: str):
    """A foreachBatch function. Each batch's rows go to a folder of its own, so a batch run again replaces what it wrote.

    The batch meets the earlier ones only, and of them the buckets of its manuals; the highest id
    comes from their markers. A folder counts once its marker stands, on any file system.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = Folder(spark, store_path)
        earlier = {n: top for n, top in stored_batches(spark, store_path).items() if n < number}
        new = insert_ignore(batch.select("doc", "page", "ordinal", "text").limit(0), batch.select("doc", "page", "ordinal", "text"), ["doc", "ordinal"], [F.col("page").asc(), F.col("text").asc()])
        buckets = [r[0] for r in batch.select(_bucket(F.col("doc"))).distinct().collect()]  # at most BUCKETS
        before = _read(spark, store_path, sorted(earlier)).where(F.col("bucket").isin(buckets)).select("doc", "ordinal")
        fresh = new.join(before, new["doc"].eqNullSafe(before["doc"]) & new["ordinal"].eqNullSafe(before["ordinal"]), "left_anti")
        numbered = surrogate_ids(fresh, ["doc", "ordinal"], start=max(earlier.values(), default=0))
        name = f"batch={number}"
        numbered.select("id", "doc", "page", "ordinal", "text", _bucket(F.col("doc")).alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{store_path}/{name}")
        written = _read(spark, store_path, [number]).agg(F.max("id")).first()[0]
        folder.write(f"{name}/_top", str(max([*earlier.values(), written or 0])))

    return run


def start_ingest(spark: SparkSession, source: str, store_path: str, checkpoint: str) -> StreamingQuery:
    """Ingests JSON lines files as they appear in ``source``; ends when none are left."""
    stream = spark.readStream.schema(INPUT_SCHEMA).json(source)
    return stream.writeStream.foreachBatch(ingest_batch(store_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """(key, start, end, events): trace sessions parted by quiet times; works on streams with a watermark and on batches."""
    return events.where(F.col(key).isNotNull()).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
