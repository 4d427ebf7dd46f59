"""Reciprocal rank fusion and what is read off the fused list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rrf(lists: DataFrame, rrf_k: int = 60, k: int | None = None) -> DataFrame:
    """(qid, id, score, sources, rank) from ranked lists (qid, id, rank, source, list_no).

    An id's score is the sum of 1 / (rrf_k + rank) over the lists; ties go to the id that the
    earlier list has, and there to the better rank. ``sources`` are in list order.
    """
    seen = F.array_sort(F.collect_list(F.struct("list_no", "rank", "source")))
    fused = lists.groupBy("qid", "id").agg(F.round(F.sum(F.lit(1.0) / (rrf_k + F.col("rank"))), 9).alias("score"), seen.alias("seen"))
    first = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.col("seen")[0]["list_no"], F.col("seen")[0]["rank"], "id"))
    out = fused.withColumn("rank", first).withColumn("sources", F.transform("seen", lambda x: x["source"])).drop("seen")
    return out if k is None else out.where(F.col("rank") <= k)


def confidence(score: Column, sources: Column) -> Column:
    """Confidence of a query's best hit: its share of the ceiling 2/61, less if one list alone has it."""
    share = F.least(score / F.lit(2.0 / 61), F.lit(1.0))
    return F.round(share * F.when(F.size(sources) > 1, 1.0).otherwise(0.6), 4)


def top_source(sources: Column) -> Column:
    return F.when(F.size(sources) > 1, "both").otherwise(sources[0])
