"""Problem 8: mixing sources to target shares of tokens.

Documents get hash-random keys; within a source they are ordered by key and their token counts
summed up by distributed prefix sums (per key range, then over the ranges). Each source is
cut where its budget ends; small sources run through whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.bpe import DEFAULT_VOCAB, count_tokens
from plumbline.session import cut_lineage, spread

SEED = 20240
RANGES = 1024


def _sized(documents: DataFrame, targets: DataFrame, vocab_path: str) -> DataFrame:
    wanted = targets.where("source is not null").select("source").distinct()
    docs = spread(documents.where("doc_id is not null and source is not null").select("doc_id", "source", "text")).join(F.broadcast(wanted), "source")
    return count_tokens(docs, ["doc_id", "source"], vocab_path=vocab_path)


def plan_shares(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per listed source: its tokens, its budget, whole epochs and the rest to cut.

    Sources that do not exist (or have no tokens) get nothing and their share is spread over
    the others in proportion. Without ``total_tokens`` the total is the largest at which every
    source can meet its share within ``max_repeats``. With it, a source short of tokens gives
    all it may, and the actual shares show it.
    """
    have = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    t = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    rows = t.join(F.broadcast(have), "source", "left").na.fill({"tokens": 0, "docs": 0})
    everywhere = Window.partitionBy()  # one row per listed source
    usable = (F.col("tokens") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    share = F.when(usable, F.col("target_share")).otherwise(0.0)
    rows = rows.withColumn("share", F.try_divide(share, F.sum(share).over(everywhere)))
    cap = F.col("tokens") * F.col("max_repeats")
    if total_tokens is None:
        rows = rows.withColumn("total", F.min(F.when(F.col("share") > 0, cap / F.col("share"))).over(everywhere))
    else:
        rows = rows.withColumn("total", F.lit(float(total_tokens)))
    rows = rows.withColumn("budget", F.coalesce(F.least(F.floor(F.col("total") * F.col("share") + 1e-6), cap), F.lit(0)).cast("bigint"))
    epochs = F.coalesce(F.floor(F.try_divide("budget", "tokens")), F.lit(0)).cast("int")
    return rows.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).drop("total")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, vocab_path: str = DEFAULT_VOCAB) -> tuple[DataFrame, DataFrame]:
    """(chosen documents, plan). Chosen: doc_id, source, tokens, repeats.

    A document without tokens (null or empty text) or without source is never chosen; rows
    repeated under one doc_id count each; ties of the random key go by doc_id. The cut is the
    last document that ends within the source's budget, so a source falls short by less than
    one document.
    """
    sized = cut_lineage(_sized(documents, targets, vocab_path))
    plan = cut_lineage(plan_shares(sized, targets, total_tokens))
    key = F.xxhash64(F.lit(seed), "doc_id")
    keyed = sized.where("tokens > 0").withColumn("key", key).withColumn("part", F.shiftrightunsigned("key", 54).cast("int"))
    sums = keyed.groupBy("source", "part").agg(F.sum("tokens").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).drop("n")
    inside = F.sum("tokens").over(Window.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    summed = keyed.withColumn("inside", inside).join(sums, ["source", "part"]).withColumn("reach", F.col("before") + F.col("inside"))
    placed = summed.join(F.broadcast(plan.select("source", "epochs", "rest")), "source")
    repeats = F.col("epochs") + F.when(F.col("reach") <= F.col("rest"), 1).otherwise(0)
    return placed.select("doc_id", "source", "tokens", repeats.cast("int").alias("repeats")).where("repeats > 0"), plan


def mix_report(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, vocab_path: str = DEFAULT_VOCAB) -> DataFrame:
    """Actual shares: source, target_share, max_repeats, tokens, budget, used_tokens, used_docs, most_repeats, actual_share."""
    chosen, plan = mix(documents, targets, total_tokens, seed, vocab_path)
    used = chosen.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.count("*").alias("used_docs"), F.max("repeats").alias("most_repeats")
    )
    rows = plan.join(F.broadcast(used), "source", "left").na.fill({"used_tokens": 0, "used_docs": 0, "most_repeats": 0})
    actual = F.coalesce(F.try_divide("used_tokens", F.sum("used_tokens").over(Window.partitionBy())), F.lit(0.0))
    return rows.select("source", "target_share", "max_repeats", "tokens", "budget", "used_tokens", "used_docs", "most_repeats", actual.alias("actual_share"))
