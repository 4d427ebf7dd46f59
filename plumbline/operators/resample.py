"""Deterministic sampling: the md5 of seed and id orders rows alike in every engine."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw(seed: Column | str | int, ident: Column) -> Column:
    """Sort key of a pseudo-random order."""
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(s.cast("string"), F.lit(":"), ident.cast("string")))


def ordered_position(df: DataFrame, by: list[str], seed: Column | str | int, ident: str) -> DataFrame:
    """Adds ``pos`` (from 1) and ``n``, the rows of its set, in pseudo-random order.

    Rows are numbered within 256 ranges of the sort key and the ranges' counts summed up, so no
    task sorts a whole set.
    """
    keyed = df.withColumn("__d", draw(seed, F.col(ident))).withColumn("__b", F.substring("__d", 1, 2))
    whole = Window.partitionBy(*by)
    ranges = keyed.groupBy(*by, "__b").agg(F.count("*").alias("__c"))
    ranges = ranges.withColumn("__before", F.sum("__c").over(whole.orderBy("__b")) - F.col("__c")).withColumn("n", F.sum("__c").over(whole)).drop("__c")
    here = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__d", ident))
    return keyed.join(ranges, [*by, "__b"]).withColumn("pos", here + F.col("__before")).drop("__d", "__b", "__before")


def half_split(df: DataFrame, seed: int, ident: str = "id") -> DataFrame:
    """Adds ``part``: the first half (rounded down) is cal, the rest test."""
    return ordered_position(df, [], seed, ident).withColumn("part", F.when(F.col("pos") <= F.floor(F.col("n") / 2), "cal").otherwise("test")).drop("pos", "n")


def three_way_trials(df: DataFrame, trials: int, ident: str = "id") -> DataFrame:
    """Every row once per trial with ``trial`` and ``part`` (thirds: cal, val, the rest test)."""
    each = df.crossJoin(df.sparkSession.range(trials).withColumnRenamed("id", "trial"))
    pos = ordered_position(each, ["trial"], F.col("trial"), ident)
    third = F.floor(F.col("n") / 3)
    part = F.when(F.col("pos") <= third, "cal").when(F.col("pos") <= 2 * third, "val").otherwise("test")
    return pos.withColumn("part", part).drop("pos", "n")


def sized_trials(df: DataFrame, trials: int, sizes: list[int], n_val: int, n_test: int, ident: str = "id") -> DataFrame:
    """Rows per (n_cal, trial) with fixed validation and test sizes; sizes that do not fit give no rows."""
    each = df.crossJoin(df.sparkSession.range(trials).withColumnRenamed("id", "trial"))
    pos = ordered_position(each, ["trial"], F.col("trial"), ident).withColumn("n_cal", F.explode(F.array(*[F.lit(s) for s in sizes])))
    p, c = F.col("pos"), F.col("n_cal")
    part = F.when(p <= c, "cal").when(p <= c + n_val, "val").when(p <= c + n_val + n_test, "test")
    return pos.where(c + n_val + n_test <= F.col("n")).withColumn("part", part).where("part is not null").drop("pos", "n")


def bootstrap_counts(df: DataFrame, draws: int, n: Column, ident: str = "pos") -> DataFrame:
    """Rows repeated by bootstrap draws: joins ``df`` (pos from 0, n) with a hash-made index per draw."""
    spark = df.sparkSession
    picks = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(df.select(F.col(ident).alias("k"), n.alias("n")))
    index = F.conv(F.substring(F.md5(F.concat(F.col("draw").cast("string"), F.lit(":"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("bigint") % F.col("n")
    return picks.select("draw", index.alias(ident)).join(df, ident)


def seeded_permutation(n: int, seed: int) -> list[int]:
    """Positions in the order of Python's seeded shuffle, for parity with recorded splits."""
    idx = list(range(n))
    random.Random(seed).shuffle(idx)
    return idx


def take_first(df: DataFrame, n: int, seed: int, ident: str) -> DataFrame:
    """A sample of n rows without replacement, the same every time."""
    return df.orderBy(draw(seed, F.col(ident)), ident).limit(n)


def nested_subsets(df: DataFrame, positives: DataFrame, sizes: list[int], seed: int, ident: str) -> DataFrame:
    """(size, id): all positives and as many other rows in one fixed order; smaller sets lie within larger ones."""
    keys = df.select(F.col(ident).alias("id")).distinct()
    pos = positives.select(F.col(ident).alias("id")).distinct().join(keys, "id", "left_semi")
    counts = F.broadcast(pos.agg(F.count("*").alias("p")))  # one row
    rest = keys.join(pos, "id", "left_anti").crossJoin(counts)
    ranked = ordered_position(rest, [], seed, "id").withColumnRenamed("pos", "r")
    size = F.explode(F.array(*[F.lit(s) for s in sizes]))
    others = ranked.select("id", "r", "p", size.alias("size")).where(F.col("r") <= F.col("size") - F.col("p")).select("size", "id")
    return pos.select(size.alias("size"), "id").unionByName(others)
