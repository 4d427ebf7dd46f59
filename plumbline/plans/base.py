"""Registration, and the inputs that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import word_tokens
from plumbline.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return register


#: The stated query set of searches: ids divisible by this, against all rows.
ASK_EVERY = 100


def asked(spark: SparkSession, sf: str, every: int = ASK_EVERY) -> DataFrame:
    """(qid, question): the stated query set, every question whose id's number is divisible by ``every``."""
    n = F.regexp_extract("id", r"(\d+)$", 1).try_cast("bigint")
    g = table(spark, sf, "golden_generated").where(n % every == 0).groupBy("id").agg(F.min("question").alias("question"))
    return g.withColumnRenamed("id", "qid")


SQL_ASKED = r"asked AS (SELECT id AS qid, min(question) AS question FROM golden_generated WHERE try_cast(regexp_extract(id, '(\d+)$', 1) AS BIGINT) % 100 = 0 GROUP BY id)"


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "chunks").where("text is not null").select("id", "doc", "page", "text"))


SQL_CORPUS = "corpus AS (SELECT id, doc, page, text FROM chunks WHERE text IS NOT NULL)"


def query_terms(spark: SparkSession, sf: str, every: int = ASK_EVERY) -> DataFrame:
    """(qid, term): one row per occurrence."""
    return asked(spark, sf, every).select("qid", F.explode(word_tokens(F.col("question"))).alias("term"))


SQL_TOKENS = r"""toks AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM corpus),
lens AS (SELECT id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS dl FROM corpus),
totals AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM lens),
post AS (SELECT id, term, least(count(*), 65535) AS tf FROM toks GROUP BY id, term),
dfs AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term)"""
SQL_QTERMS = r"qterms AS (SELECT qid, unnest(regexp_extract_all(lower(question), '[\p{L}\p{N}_]{2,}')) AS term FROM asked), qtf AS (SELECT qid, term, count(*) AS qtf FROM qterms GROUP BY qid, term)"
SQL_BM25 = """weights AS (SELECT p.id, p.term, p.tf, ln(1 + (t.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * p.tf / (p.tf + 0.9::DOUBLE * (1 - 0.4::DOUBLE + 0.4::DOUBLE * l.dl / t.avgdl)) AS w
FROM post p JOIN dfs d USING (term) JOIN lens l ON l.id = p.id CROSS JOIN totals t),
bm_scored AS (SELECT q.qid, w.id, round(sum(w.w * q.qtf), 6) AS score FROM qtf q JOIN weights w USING (term) GROUP BY q.qid, w.id),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm_scored QUALIFY rank <= 100)"""
#: Vector queries: every embedding whose id is divisible by 100, against all.
SQL_DENSE = """dq AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
dv AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
dense_scored AS (SELECT q.qid, d.id, round(list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(d.v, d.v)), 6) AS score FROM dq q CROSS JOIN dv d),
dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM dense_scored QUALIFY rank <= 100)"""
