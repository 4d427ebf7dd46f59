"""Problem 5: lines that return all over one manual.

Lines are parsed into a token tree of fixed depth: the length of the line's letters, its first
two tokens and its last token (a token is four letters of the line in lower case, other
characters dropped). The leaves hold templates whose differing tokens become wildcards. The
coverage of a leaf can only exceed that of a line in it, so leaves below the thresholds are
dropped before any line is shuffled with its text; partition trees merge by adding the
coverage of equal leaves. Lines of the remaining leaves are then counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import spread

MIN_LETTERS = 12
MIN_ROWS = 6
MIN_SHARE = 0.03
TOKEN = 4
SALTS = 16


def _letters(text: Column) -> Column:
    """Lower-case letters a-z of each line."""
    return F.split(F.regexp_replace(F.lower(text), r"[^a-z\n]+", ""), "\n")


def _leaf(key: Column) -> Column:
    """The line's path in the token tree, as a hash."""
    return F.xxhash64(F.length(key), F.substring(key, 1, TOKEN), F.substring(key, TOKEN + 1, TOKEN), F.substring(key, -TOKEN, TOKEN))


def _rows_per_doc(df: DataFrame) -> DataFrame:
    return df.groupBy("doc").agg(F.count("*").alias("doc_rows"))


def _enough(rows: Column, doc_rows: Column, min_rows: int, min_share: float) -> Column:
    return (rows >= min_rows) & (rows >= min_share * doc_rows)


def hot_leaves(df: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc, leaf, leaf_rows): leaves that cover enough rows of their manual.

    A row counts once per leaf. Partial counts are made before the shuffle, so a manual with a
    third of all rows is no hot key: the shuffle is on (doc, leaf).
    """
    leaves = F.array_distinct(F.transform(F.filter(_letters(F.col("text")), lambda k: F.length(k) >= MIN_LETTERS), _leaf))
    counted = spread(df.where("text is not null and doc is not null").select("doc", "text")).select("doc", F.explode(leaves).alias("leaf")).groupBy("doc", "leaf").agg(F.count("*").alias("leaf_rows"))
    counted = counted.where(F.col("leaf_rows") >= min_rows)
    docs = _rows_per_doc(df)
    return counted.join(docs, "doc").where(_enough(F.col("leaf_rows"), F.col("doc_rows"), min_rows, min_share)).select("doc", "leaf", "leaf_rows", "doc_rows")


def _candidate_lines(df: DataFrame, hot: DataFrame) -> DataFrame:
    """(id, doc, leaf, line_no, key, doc_rows) of the lines in hot leaves.

    The hot leaves of a manual are gathered into one array (at most lines-per-row / min_share
    entries, whatever the input's size), so each chunk meets them once and its other lines
    never leave the scan.
    """
    per_doc = hot.groupBy("doc").agg(F.collect_list("leaf").alias("hot"), F.first("doc_rows").alias("doc_rows"))
    salted = spread(df.where("text is not null").select("id", "doc", "text")).select("id", "doc", "text", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    per_doc = per_doc.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = F.transform(_letters(F.col("text")), lambda k, i: F.struct(i.alias("line_no"), k.alias("key"), _leaf(k).alias("leaf")))
    keys = F.filter(keys, lambda x: (F.length(x["key"]) >= MIN_LETTERS) & F.array_contains(F.col("hot"), x["leaf"]))
    lines = salted.join(per_doc, ["doc", "salt"]).select("id", "doc", "doc_rows", F.inline(keys))
    return lines


def repeated_lines(df: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """p5_found: (chunk_id, line_no) of the lines to remove.

    A line is removed if its letters a-z in lower case (12 or more) stand in at least
    ``min_rows`` rows of its manual and in ``min_share`` of them. Null texts count as rows of the
    manual but have no lines; a line standing twice in a row counts once and both are
    removed; rows repeated under another id count each; a null manual has no cases.
    """
    lines = _candidate_lines(df, hot_leaves(df, min_rows, min_share))
    keyed = lines.select("id", "doc", "doc_rows", "line_no", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))
    per_row = keyed.groupBy("doc", "h1", "h2", "id").agg(F.collect_list("line_no").alias("lines"), F.first("doc_rows").alias("doc_rows"))
    counts = per_row.groupBy("doc", "h1", "h2").agg(F.count("*").alias("rows"), F.first("doc_rows").alias("doc_rows"))
    cases = counts.where(_enough(F.col("rows"), F.col("doc_rows"), min_rows, min_share)).select("doc", "h1", "h2")
    found = keyed.select("id", "doc", "line_no", "h1", "h2").join(cases, ["doc", "h1", "h2"])
    return found.select(F.col("id").alias("chunk_id"), F.col("line_no").cast("int").alias("line_no"))


def line_templates(df: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc, template, line_kinds, template_rows): the trees' hot leaves as templates.

    Token slots in which the leaf's lines differ become ``<*>``. Tokens are compared slot by
    slot within the aggregation, so no leaf is collected.
    """
    lines = _candidate_lines(df, hot_leaves(df, min_rows, min_share))
    slots = F.transform(F.sequence(F.lit(0), F.floor((F.length("key") - 1) / TOKEN).cast("int")), lambda i: F.struct(i.alias("slot"), F.substring(F.col("key"), i * TOKEN + 1, F.lit(TOKEN)).alias("token")))
    per_leaf = lines.groupBy("doc", "leaf").agg(F.count_distinct("id").alias("template_rows"), F.approx_count_distinct("key").alias("line_kinds"))
    distinct_keys = lines.select("doc", "leaf", "key").distinct()
    per_slot = distinct_keys.select("doc", "leaf", F.inline(slots.alias("s"))).groupBy("doc", "leaf", "slot").agg(F.min("token").alias("lo"), F.max("token").alias("hi"))
    token = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("<*>")
    text = per_slot.groupBy("doc", "leaf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", token.alias("t")))), lambda x: x["t"]), " ").alias("template"))
    return text.join(per_leaf, ["doc", "leaf"]).select("doc", "template", "line_kinds", "template_rows")


def without_repeated_lines(df: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, doc, removed, text): every chunk without its repeated lines; null texts stay null."""
    gone = repeated_lines(df, min_rows, min_share).groupBy("chunk_id").agg(F.collect_set("line_no").alias("gone"))
    joined = df.select("id", "doc", "text").join(gone, F.col("id") == F.col("chunk_id"), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.col("gone"), i.cast("int")))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select("id", "doc", F.coalesce(F.size("gone"), F.lit(0)).alias("removed"), text.alias("text"))
