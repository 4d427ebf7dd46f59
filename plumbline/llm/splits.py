"""Problem 2: train, validation and test splits that keep tied questions together.

Questions are tied by a cited page or by their wording. The groups are connected components;
their sizes are balanced into many equal bins by largest differencing, and whole bins go to
the splits by the target proportions.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.session import cut_lineage

SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
BINS = 100
SALTS = 8


def manual_key(name: Column) -> Column:
    """The manual's name without folder, extension, case and word separators."""
    bare = F.regexp_replace(F.trim(name), r"^.*[/\\]", "")
    bare = F.regexp_replace(bare, r"\s*\.[A-Za-z][A-Za-z0-9]{1,4}\s*$", "")
    key = F.regexp_replace(F.lower(bare), r"(?:%20|[-_\s ‐‑])+", "-")
    return F.nullif(F.regexp_replace(key, r"^-+|-+$", ""), F.lit(""))


def wording_key(question: Column) -> Column:
    """The question apart from case, white space and punctuation; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(question), r"[^\p{L}\p{N}\p{M}]+", ""), F.lit(""))


def _least_over(nodes: DataFrame, key: str) -> DataFrame:
    """Each node's ``label`` lowered to the least label under its ``key``.

    The key's side has one row a key, repeated per salt, so a key that a third of the rows
    share is spread over ``SALTS`` join partitions.
    """
    least = nodes.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("label").alias("least"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return nodes.join(least, [key, "salt"], "left").withColumn("label", F.least("label", F.coalesce("least", "label"))).drop("least")


def question_groups(df: DataFrame) -> DataFrame:
    """(id, first_id, page_key): every distinct id with the least id of its component.

    Null ids are dropped; rows repeated under one id count once, each of them tying; a null
    or blank question or name and a page below 1 tie nothing. Labels are lowered along pages
    and wordings in turn and through the label's own label, until none changes; each round is
    checkpointed.
    """
    page = F.when(F.col("gold_page") >= 1, F.concat_ws("#", manual_key(F.col("gold_doc")), F.col("gold_page").cast("string")))
    page = F.when(manual_key(F.col("gold_doc")).isNotNull(), page)
    rows = df.where("id is not null").select("id", page.alias("page_key"), wording_key(F.col("question")).alias("words")).distinct()
    nodes = cut_lineage(rows.withColumn("label", F.col("id")).withColumn("salt", F.pmod(F.xxhash64("id", "page_key", "words"), F.lit(SALTS)).cast("int")))
    while True:
        nxt = _least_over(_least_over(nodes.withColumn("old", F.col("label")), "page_key"), "words")
        own = nxt.groupBy("id").agg(F.min("label").alias("own"))  # rows of one id agree
        nxt = nxt.join(own, "id").withColumn("label", F.col("own")).drop("own")
        jump = own.select(F.col("id").alias("label"), F.col("own").alias("further")).where("label <> further")
        jump = jump.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        nxt = nxt.join(jump, ["label", "salt"], "left").withColumn("label", F.coalesce("further", "label")).drop("further")
        nodes = cut_lineage(nxt)
        if nodes.where("label <> old").isEmpty():
            break
        nodes = nodes.drop("old")
    return nodes.groupBy("id").agg(F.min("label").alias("first_id"), F.min("page_key").alias("page_key"))


def tied_questions(df: DataFrame) -> DataFrame:
    """p2_found: (first_id, id) for each id of a group but its smallest."""
    return question_groups(df).where("first_id <> id").select("first_id", "id")


def difference_into_bins(weights: dict[int, int], bins: int = BINS) -> dict[int, list[tuple[int, int]]]:
    """Largest differencing of a multiset {weight: how many} into ``bins`` equal bins.

    As many copies of a weight as divide evenly are dealt straight to all bins; the rest, below
    ``bins`` per distinct weight, go through the differencing: the two partitions with the
    largest spread are combined, the heaviest bins of one with the lightest of the other, until
    one is left. Gives {weight: [(bin, copies), ...]}.
    """
    even = {w: n // bins for w, n in weights.items()}
    # A bin's content is None, a weight, or a pair of contents.
    heap: list[tuple[int, int, list[tuple[int, object]]]] = []
    serial = 0
    for w in sorted(weights, reverse=True):
        for _ in range(weights[w] % bins):
            heap.append((-w, serial, [(w, w)] + [(0, None)] * (bins - 1)))
            serial += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted(((x + y, (p, q)) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda t: -t[0])
        low = merged[-1][0]
        heapq.heappush(heap, (-(merged[0][0] - low), serial, merged))
        serial += 1
    out = {w: {k: n for k in range(bins)} if (n := even[w]) else {} for w in weights}

    for k, (_, content) in enumerate(heap[0][2] if heap else []):
        stack = [content]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            elif x is not None:
                out[x][k] = out[x].get(k, 0) + 1
    return {w: sorted(d.items()) for w, d in out.items()}


def split_questions(df: DataFrame, splits: tuple[tuple[str, float], ...] = SPLITS, bins: int = BINS) -> DataFrame:
    """(id, first_id, split): tied questions share a split; sizes follow the proportions.

    Only the histogram of group sizes reaches the driver: n questions have at most sqrt(2n)
    distinct sizes. A group larger than a bin makes its bin heavy; the bins go to the
    splits heaviest first, each to the split that lacks most.
    """
    groups = cut_lineage(question_groups(df).select("id", "first_id"))
    sizes = cut_lineage(groups.groupBy("first_id").agg(F.count("*").alias("size")))
    histogram = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()}
    dealt = difference_into_bins(histogram, bins)
    load = [0] * bins
    for w, parts in dealt.items():
        for k, n in parts:
            load[k] += w * n
    total, given, owner = sum(load), dict.fromkeys((s for s, _ in splits), 0), {}
    for k in sorted(range(bins), key=lambda k: (-load[k], k)):
        best = max(splits, key=lambda s: (s[1] * total - given[s[0]], s[1]))[0]
        owner[k] = best
        given[best] += load[k]
    ranges = []
    for w, parts in dealt.items():
        per_split: dict[str, int] = {}
        for k, n in parts:
            per_split[owner[k]] = per_split.get(owner[k], 0) + n
        lo = 0
        for s, n in sorted(per_split.items()):
            ranges.append((w, lo, lo + n, s))
            lo += n
    # The nth group of a size, by hash buckets so that no window holds all groups of one size.
    keyed = sizes.withColumn("bucket", F.pmod(F.xxhash64("first_id"), F.lit(256)))
    offsets = keyed.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    offsets = offsets.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("first_id")) - 1
    ranked = keyed.withColumn("nth", nth).join(offsets, ["size", "bucket"]).withColumn("nth", F.col("nth") + F.col("before"))
    schema = T.StructType([T.StructField("size", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("split", T.StringType())])
    table = F.broadcast(df.sparkSession.createDataFrame(ranges, schema))  # at most sqrt(2n) sizes x 3 splits
    placed = ranked.join(table, "size").where("nth >= lo and nth < hi").select("first_id", "split")
    return groups.join(placed, "first_id").select("id", "first_id", "split")


def split_report(df: DataFrame, splits: tuple[tuple[str, float], ...] = SPLITS, bins: int = BINS) -> DataFrame:
    """(split, target, questions, share) of the assignment."""
    got = split_questions(df, splits, bins).groupBy("split").agg(F.count("*").alias("questions"))
    want = df.sparkSession.createDataFrame(list(splits), "split string, target double")
    total = F.sum("questions").over(Window.partitionBy())
    return want.join(got, "split", "left").na.fill({"questions": 0}).withColumn("share", F.try_divide("questions", total))
