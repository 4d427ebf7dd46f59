"""Relational operations of the chunk store, on immutable DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``existing`` and those rows of ``new`` whose keys are in neither it nor an earlier new row.

    The first writer wins, also within the batch (``order`` says who is first). Null keys equal
    each other, so they are inserted once. Columns beyond those of ``existing`` are dropped.
    """
    first = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    same = [first[k].eqNullSafe(existing[k]) for k in keys]
    fresh = first.join(existing, same, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def surrogate_ids(df: DataFrame, order: list[str], start: int = 0, id_col: str = "id") -> DataFrame:
    """Consecutive ids from ``start`` + 1 in the given order.

    Rows are ranged over partitions by ``order``; only the partitions' row counts are gathered,
    so no task sorts everything. Rows alike in ``order`` are numbered in some order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    part, here = F.spark_partition_id(), F.monotonically_increasing_id()
    numbered = ranged.withColumn("__p", part).withColumn("__i", here.bitwiseAND((1 << 33) - 1))
    from plumbline.session import cut_lineage

    numbered = cut_lineage(numbered)  # partition numbers must not change between the two uses
    sizes = sorted((r["__p"], r["n"]) for r in numbered.groupBy("__p").agg(F.count("*").alias("n")).collect())
    before, total = {}, start
    for p, n in sizes:
        before[p] = total
        total += n
    offsets = df.sparkSession.createDataFrame(list(before.items()), "__p int, __b bigint") if before else None
    if offsets is None:
        return df.withColumn(id_col, F.lit(0).cast("bigint")).limit(0)
    return numbered.join(F.broadcast(offsets), "__p").withColumn(id_col, F.col("__b") + F.col("__i") + 1).drop("__p", "__b", "__i")


def above_mark(source: DataFrame, indexed: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of ``source`` newer than the highest indexed id; all of them if nothing is indexed."""
    mark = indexed.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__mark"))
    return source.crossJoin(F.broadcast(mark)).where(F.col(id_col) > F.col("__mark")).drop("__mark")  # one row


def upsert_last(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the last in ``order``. Null keys form one key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def ordered_lookup(wanted: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows for a list of (pos, id), in the list's order: unknown ids drop out, repeated ones repeat."""
    return wanted.select("pos", id_col).join(rows, id_col)


def page_texts(df: DataFrame, sep: str = " ") -> DataFrame:
    """(doc, page, text): the texts of a page joined in order of ordinal and id; null texts are skipped."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "id", "text")))
    return df.where("text is not null").groupBy("doc", "page").agg(F.array_join(F.transform(parts, lambda x: x["text"]), sep).alias("text"))
