"""Queries that evaluate retrieval runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import fusion, metrics
from plumbline.plans.base import SQL_DENSE, corpus, query
from plumbline.plans.retrieval import SQL_RRF, WITH_BM25, bm25_run, dense_run, fused_run, ivf_run
from plumbline.session import table

#: Relevance for the vector run: embeddings of the query's own label.
SQL_QRELS = "qrels AS (SELECT q.vec_id AS qid, d.vec_id AS id FROM embeddings q JOIN embeddings d ON d.label = q.label AND d.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)"


def label_qrels(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    q = e.where("id % 100 = 0").withColumnRenamed("id", "qid")
    return e.join(q, "label").where("id <> qid").select("qid", "id")


@query("WITH " + SQL_DENSE + ", " + SQL_QRELS + """, j AS (SELECT r.qid, r.id, d.rank FROM qrels r LEFT JOIN dense d ON d.qid = r.qid AND d.id = r.id),
per AS (SELECT qid, count(*) AS n, min(rank) FILTER (rank <= 10) AS first, count(*) FILTER (rank <= 10) AS r10, count(*) FILTER (rank <= 100) AS r100, coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg FROM j GROUP BY qid),
ideal AS (SELECT *, list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) AS best FROM per)
SELECT count(*) AS judged, round(avg(coalesce(1.0::DOUBLE / first, 0)), 4) AS mrr_10, round(avg(r10::DOUBLE / n), 4) AS recall_10, round(avg(r100::DOUBLE / n), 4) AS recall_100, round(avg(dcg / best), 4) AS ndcg_10 FROM ideal""")
def mrr_recall_ndcg(spark, sf):
    return metrics.ranking_quality(dense_run(spark, sf), label_qrels(spark, sf))


@query("WITH " + SQL_DENSE + """, e8 AS (SELECT vec_id AS id, list_transform(embedding, lambda x: round(x::DOUBLE * 127)) AS v FROM embeddings),
s8 AS (SELECT q.id AS qid, d.id, round(list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(d.v, d.v)), 6) AS score FROM e8 q CROSS JOIN e8 d WHERE q.id % 100 = 0),
approx AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s8)
SELECT count(*) AS queries, round(avg(n / 10.0::DOUBLE), 4) AS overlap FROM (SELECT qid, count(*) FILTER (x) AS n FROM (SELECT a.qid, b.id IS NOT NULL AS x FROM (SELECT * FROM dense WHERE rank <= 10) a LEFT JOIN (SELECT * FROM approx WHERE rank <= 10) b ON a.qid = b.qid AND a.id = b.id) GROUP BY qid)""")
def overlap_at_k(spark, sf):
    """The exact run against that over vectors rounded to 8 bits."""
    from plumbline.operators.dense import block_top_k

    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.round(x.cast("double") * 127).cast("float")).alias("vec"))
    return metrics.overlap_at(dense_run(spark, sf, 10), block_top_k(v.where("id % 100 = 0").withColumnRenamed("id", "qid"), v, 10), 10)


@query()
def overlap_ivf_at_k(spark, sf):
    """The exact run against the inverted file's, over the stated query set."""
    return metrics.overlap_at(dense_run(spark, sf, 10), ivf_run(spark, sf, 10), 10)


@query("""SELECT kind, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 2) AS p50, round(quantile_cont(latency_ms, 0.95), 2) AS p95, round(quantile_cont(latency_ms, 0.99), 2) AS p99, round(avg(latency_ms), 2) AS mean
FROM trace_log WHERE latency_ms IS NOT NULL GROUP BY kind""")
def latency_percentiles(spark, sf):
    return metrics.latency_summary(table(spark, sf, "trace_log"), "latency_ms", ["kind"])


SQL_GOLD = "gold AS (SELECT id AS qid, min(gold_doc) AS gold_doc, min(gold_page) AS gold_page FROM golden_generated GROUP BY id HAVING min(gold_doc) IS NOT NULL AND min(gold_page) IS NOT NULL)"
SQL_HIT = """hits AS (SELECT r.qid, r.rank, c.doc, c.page FROM {run} r JOIN corpus c ON c.id = r.id),
{name} AS (SELECT g.qid, min(h.rank) AS hit_rank FROM (SELECT g.* FROM gold g SEMI JOIN asked a ON a.qid = g.qid) g LEFT JOIN hits h ON h.qid = g.qid AND h.doc = g.gold_doc AND abs(h.page - g.gold_page) <= {slack} GROUP BY g.qid)"""


def gold_pages(spark, sf):
    from plumbline.plans.base import asked

    g = table(spark, sf, "golden_generated").groupBy("id").agg(F.min("gold_doc").alias("gold_doc"), F.min("gold_page").alias("gold_page"))
    return g.where("gold_doc is not null and gold_page is not null").withColumnRenamed("id", "qid").join(asked(spark, sf).select("qid"), "qid", "left_semi")


def page_ranks(spark, sf, run, slack: int = 1):
    hits = run.join(corpus(spark, sf).drop("text"), "id").select("qid", "rank", "doc", "page")
    return metrics.page_hit_ranks(hits, gold_pages(spark, sf), slack)


@query(WITH_BM25 + ", " + SQL_RRF + ", " + SQL_GOLD + ", " + SQL_HIT.format(run="rrf", name="ranks", slack=1) + " SELECT qid, hit_rank::INTEGER AS hit_rank FROM ranks")
def page_slack_rank(spark, sf):
    return page_ranks(spark, sf, fused_run(spark, sf))


@query(WITH_BM25 + ", " + SQL_RRF + ", " + SQL_GOLD + ", " + SQL_HIT.format(run="rrf", name="ranks", slack=1) + """ SELECT count(*) AS n, count(hit_rank) AS found, round(avg(CASE WHEN hit_rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall,
round(avg(CASE WHEN hit_rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_1, round(coalesce(avg(1.0::DOUBLE / hit_rank), 0), 6) AS mrr_found FROM ranks""")
def recall_found_only(spark, sf):
    return metrics.found_summary(page_ranks(spark, sf, fused_run(spark, sf)))


@query(WITH_BM25 + ", " + SQL_RRF + " SELECT CASE WHEN len(sources) > 1 THEN 'both' ELSE sources[1] END AS top_source, count(*) AS n FROM rrf WHERE rank = 1 GROUP BY 1")
def top_source_counts(spark, sf):
    return fused_run(spark, sf, 1).groupBy(fusion.top_source(F.col("sources")).alias("top_source")).agg(F.count("*").alias("n"))


@query(WITH_BM25 + ", " + SQL_RRF + ", " + SQL_GOLD + ", " + SQL_HIT.format(run="bm", name="x", slack=1) + ", " + SQL_HIT.format(run="rrf", name="y", slack=1).replace("hits", "hits2") + """
SELECT coalesce(x.qid, y.qid) AS qid, CASE WHEN x.hit_rank IS NULL THEN 'rescued' ELSE 'broken' END AS change FROM x FULL JOIN y ON x.qid = y.qid WHERE (x.hit_rank IS NULL) <> (y.hit_rank IS NULL)""")
def run_diff(spark, sf):
    return metrics.run_difference(page_ranks(spark, sf, bm25_run(spark, sf)), page_ranks(spark, sf, fused_run(spark, sf)))


@query(WITH_BM25 + ", " + SQL_RRF + """, c AS (SELECT a.qid, coalesce(least(r.score / (2.0::DOUBLE / 61), 1.0::DOUBLE) * CASE WHEN len(r.sources) > 1 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END, 0) AS conf FROM asked a LEFT JOIN rrf r ON r.qid = a.qid AND r.rank = 1)
SELECT g.answerable, count(*) AS n, round(avg(round(c.conf, 4)), 4) AS mean_confidence FROM c JOIN (SELECT id, bool_or(answerable) AS answerable FROM golden_generated GROUP BY id) g ON g.id = c.qid GROUP BY 1""")
def confidence_by_answerable(spark, sf):
    from plumbline.plans.retrieval import confidence

    g = table(spark, sf, "golden_generated").groupBy("id").agg(F.bool_or("answerable").alias("answerable"))
    return confidence(spark, sf).join(g, F.col("qid") == g["id"]).groupBy("answerable").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


@query("""WITH t AS (SELECT qid, coalesce(sum(latency_ms) FILTER (kind = 'retrieve'), 0) + coalesce(sum(latency_ms) FILTER (kind = 'gate'), 0) + coalesce(sum(latency_ms) FILTER (kind = 'answer'), 0) AS total FROM (SELECT DISTINCT * FROM trace_log) WHERE qid IS NOT NULL GROUP BY qid)
SELECT count(*) AS n, round(quantile_cont(total, 0.5), 2) AS p50, round(quantile_cont(total, 0.95), 2) AS p95, round(quantile_cont(total, 0.99), 2) AS p99, round(avg(total), 2) AS mean FROM t""")
def arm_latency_sum(spark, sf):
    """Latency of a whole request as the sum of its stages, per question."""
    t = table(spark, sf, "trace_log").distinct().where("qid is not null")
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("latency_ms"))), F.lit(0.0))
    per = t.groupBy("qid").agg((part("retrieve") + part("gate") + part("answer")).alias("total"))
    return metrics.latency_summary(per, "total", [])
