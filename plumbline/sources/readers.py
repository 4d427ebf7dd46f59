"""Readers: JSON lines, query and relevance files, text pages, run tables."""

from __future__ import annotations

import glob
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN_SCHEMA = "id string, type string, question string, answerable boolean, gold_doc string, gold_page int, note string, source string"


def expand_paths(patterns: Sequence[str]) -> tuple[list[str], list[str]]:
    """(existing, missing): each pattern's matches sorted, in the order of the patterns; a pattern without match is taken as a path."""
    found, missing = [], []
    for p in patterns:
        hits = sorted(glob.glob(p))
        if hits:
            found += hits
        elif re.search(r"[*?\[]", p) or "://" not in p:
            missing.append(p)
        else:
            found.append(p)
    return found, missing


def read_jsonl(spark: SparkSession, paths: Sequence[str] | str, schema: str = GOLDEN_SCHEMA) -> DataFrame:
    """Rows of JSON lines files put one after another; blank lines are skipped, missing files give no rows."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    there, _ = expand_paths(paths)
    return spark.read.schema(schema).json(there) if there else spark.createDataFrame([], schema)


def concat_sets(sets: Sequence[DataFrame]) -> DataFrame:
    """Several sets as one, absent columns null."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text) split at the first tab; lines without tab are dropped."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.size(parts) == 2).select(parts[0].try_cast("bigint").alias("qid"), parts[1].alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, id) of 'qid 0 pid 1' lines, whatever white space parts them."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(parts) >= 3)
    return rows.select(parts[0].try_cast("bigint").alias("qid"), parts[2].try_cast("bigint").alias("id")).distinct()


def read_collection(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(id, text) of 'id tab text' lines; with ``expected`` the row count and the ids 0..n-1 are checked."""
    rows = read_queries(spark, path).withColumnRenamed("qid", "id")
    if expected is not None:
        r = rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
        if (r["n"], r["d"], r["lo"], r["hi"]) != (expected, expected, 0, expected - 1):
            raise ValueError(f"expected ids 0 to {expected - 1}, once each; got {r}")
    return rows


def read_pages(spark: SparkSession, path: str, page_break: str = "\f") -> DataFrame:
    """(doc, page, text): text files, pages parted by form feeds and cleaned; pages left empty are dropped."""
    from plumbline.functions.text import clean_page

    files = spark.read.text(path, wholetext=True).withColumn("doc", F.element_at(F.split(F.input_file_name(), "/"), -1))
    pages = files.select("doc", F.posexplode(F.split("value", page_break)).alias("n", "raw"))
    return pages.select("doc", (F.col("n") + 1).alias("page"), clean_page(F.col("raw")).alias("text")).where("text <> ''")


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page, text) of PDF files, one file a row; needs the optional pypdf on the executors."""
    from plumbline.functions.text import clean_page

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                pages = PdfReader(io.BytesIO(content)).pages
                yield pd.DataFrame([(name.rsplit("/", 1)[-1], i + 1, p.extract_text() or "") for i, p in enumerate(pages)], columns=["doc", "page", "raw"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "doc string, page int, raw string")
    return raw.select("doc", "page", clean_page(F.col("raw")).alias("text")).where("text <> ''")


def vector_blobs(df: DataFrame, blob: str = "vec") -> DataFrame:
    """Float32 little-endian blobs decoded to arrays."""
    import numpy as np

    @F.pandas_udf("array<float>")
    def decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else np.frombuffer(x, dtype="<f4"))

    return df.withColumn(blob, decode(blob))
