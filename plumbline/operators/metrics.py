"""Evaluation of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_quality(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """mrr_10, recall_10, recall_100, ndcg_10 over the judged queries, four places.

    ``run`` is (qid, id, rank), ``qrels`` (qid, id). A judged query without hits counts 0.
    """
    rel = qrels.select("qid", "id").distinct()
    hits = rel.join(run.select("qid", "id", "rank"), ["qid", "id"], "left")
    gain = F.lit(1.0) / F.log2(F.col("rank") + 1.0)
    per = hits.groupBy("qid").agg(
        F.count("*").alias("n"),
        F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first"),
        F.count(F.when(F.col("rank") <= 10, 1)).alias("r10"),
        F.count(F.when(F.col("rank") <= 100, 1)).alias("r100"),
        F.coalesce(F.sum(F.when(F.col("rank") <= 10, gain)), F.lit(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    return per.agg(
        F.count("*").alias("judged"),
        F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), 4).alias("mrr_10"),
        F.round(F.avg(F.col("r10") / F.col("n")), 4).alias("recall_10"),
        F.round(F.avg(F.col("r100") / F.col("n")), 4).alias("recall_100"),
        F.round(F.avg(F.col("dcg") / ideal), 4).alias("ndcg_10"),
    )


def overlap_at(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Mean share of the first k ids that two runs have in common, over the queries of ``a``."""
    top = lambda df: df.where(F.col("rank") <= k).select("qid", "id")
    both = top(a).join(top(b), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count("*").alias("n"))
    per = a.select("qid").distinct().join(both, "qid", "left")
    return per.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce("n", F.lit(0)) / F.lit(float(k))), 4).alias("overlap"))


def latency_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, p50, p95, p99 (linear between values) and mean, two places; nulls are left out."""
    p = lambda q: F.round(F.percentile(value, q), 2)
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.round(F.avg(value), 2).alias("mean"))


def page_hit_ranks(hits: DataFrame, gold: DataFrame, slack: int = 1) -> DataFrame:
    """(qid, hit_rank): first rank whose hit lies within ``slack`` pages of the gold page of the same manual; null if none.

    The manual is joined by equality, so the page range is only tested within it.
    """
    near = (hits["qid"] == gold["qid"]) & (hits["doc"] == gold["gold_doc"]) & (F.abs(hits["page"] - gold["gold_page"]) <= slack)
    return gold.join(hits, near, "left").groupBy(gold["qid"]).agg(F.min(hits["rank"]).alias("hit_rank"))


def found_summary(ranks: DataFrame) -> DataFrame:
    """n, found, recall, recall_1 and the reciprocal rank over the found ones only (0 if none)."""
    r = F.col("hit_rank")
    return ranks.agg(
        F.count("*").alias("n"),
        F.count(r).alias("found"),
        F.round(F.avg(F.when(r.isNotNull(), 1.0).otherwise(0.0)), 6).alias("recall"),
        F.round(F.avg(F.when(r == 1, 1.0).otherwise(0.0)), 6).alias("recall_1"),
        F.round(F.coalesce(F.avg(F.lit(1.0) / r), F.lit(0.0)), 6).alias("mrr_found"),
    )


def run_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, change): queries found by ``b`` only (rescued) or by ``a`` only (broken)."""
    both = a.select("qid", F.col("hit_rank").alias("x")).join(b.select("qid", F.col("hit_rank").alias("y")), "qid", "full")
    change = F.when(F.col("x").isNull() & F.col("y").isNotNull(), "rescued").when(F.col("x").isNotNull() & F.col("y").isNull(), "broken")
    return both.withColumn("change", change).where("change is not null").select("qid", "change")


def auc(df: DataFrame, score: Column, positive: Column, by: list[str]) -> DataFrame:
    """Mann-Whitney AUC, ties counting half; null if a class is empty.

    Scores are counted per distinct value first, so the running sums go over values, not rows.
    """
    from pyspark.sql.window import Window

    per = df.where(score.isNotNull() & positive.isNotNull()).groupBy(*by, score.alias("__s")).agg(F.count(F.when(positive, 1)).alias("p"), F.count(F.when(~positive, 1)).alias("q"))
    below = F.sum("q").over(Window.partitionBy(*by).orderBy("__s")) - F.col("q")
    wins = per.withColumn("wins", F.col("p") * (below + 0.5 * F.col("q")))
    sums = wins.groupBy(*by).agg(F.sum("wins").alias("w"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    return sums.select(*by, "positives", "negatives", F.round(F.try_divide("w", F.col("positives") * F.col("negatives")), 6).alias("auc"))
