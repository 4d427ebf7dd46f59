"""Queries over lexical, dense and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import dense, fusion, lexical
from plumbline.plans.base import ASK_EVERY, SQL_ASKED, SQL_BM25, SQL_CORPUS, SQL_DENSE, SQL_QTERMS, SQL_TOKENS, asked, corpus, query, query_terms
from plumbline.session import small_side, table

WITH_BM25 = "WITH " + ",\n".join([SQL_ASKED, SQL_CORPUS, SQL_TOKENS, SQL_QTERMS, SQL_BM25])


def bm25_run(spark, sf, k: int = 100, every: int = ASK_EVERY):
    return lexical.search_texts(query_terms(spark, sf, every), corpus(spark, sf), T.corpus_words(F.col("text")), k)


def dense_run(spark, sf, k: int = 100):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return dense.block_top_k(v.where("id % 100 = 0").withColumnRenamed("id", "qid"), v, k)


@query("WITH " + ",\n".join([SQL_CORPUS, SQL_TOKENS, SQL_BM25.split(",\nbm_scored")[0]]) + " SELECT id, term, round(w, 6) AS w FROM weights")
def bm25_lucene_weights(spark, sf):
    c, words = corpus(spark, sf), T.word_tokens(F.col("text"))
    return lexical.term_weights(lexical.postings(c, "id", words), lexical.corpus_totals(c, words)).select("id", "term", F.round("w", 6).alias("w"))


@query(WITH_BM25 + " SELECT qid, id, score, rank::INTEGER AS rank FROM bm")
def bm25_lucene_topk(spark, sf):
    return bm25_run(spark, sf)


#: The lexical index folds case and strips the marks of Latin letters.
SQL_FTS = r"""WITH """ + SQL_ASKED + """, """ + SQL_CORPUS + r""",
toks AS (SELECT id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS term FROM corpus),
lens AS (SELECT id, len(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS dl FROM corpus),
totals AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM lens),
post AS (SELECT id, term, count(*) AS tf FROM toks GROUP BY id, term),
dfs AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term),
qterms AS (SELECT qid, lower(unnest(regexp_extract_all(question, '[A-Za-z0-9]+'))) AS term FROM asked),
qtf AS (SELECT qid, term, count(*) AS qtf FROM qterms GROUP BY qid, term),
w AS (SELECT p.id, p.term, greatest(CASE WHEN ln((t.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((t.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) END, 0)
 * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * l.dl / t.avgdl)) AS w FROM post p JOIN dfs d USING (term) JOIN lens l ON l.id = p.id CROSS JOIN totals t),
s AS (SELECT q.qid, w.id, round(sum(w.w * q.qtf), 6) AS score FROM qtf q JOIN w USING (term) GROUP BY q.qid, w.id)
SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20"""


@query(SQL_FTS)
def bm25_fts5_topk(spark, sf):
    marks = r"\p{Mn}+"
    folded = F.regexp_replace(F.expr("translate(lower(text), 'äöüéèêëáàâíìîïóòôúùûñç', 'aoueeeeaaaiiiiooouuunc')"), marks, "")
    words = F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    words = T.ascii_or(F.col("text"), T.ascii_tokens(F.col("text")), words)
    c = corpus(spark, sf)
    q = asked(spark, sf).select("qid", F.explode(F.transform(T.query_tokens(F.col("question")), F.lower)).alias("term"))
    return lexical.search_texts(q, c, words, 20, 1.2, 0.75, "fts")


@query("WITH " + SQL_DENSE + " SELECT qid, id, score, rank::INTEGER AS rank FROM dense WHERE rank <= 20")
def cosine_topk(spark, sf):
    """All inside the JVM: the stated query vectors, of checked size, against all vectors."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = v.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    met = v.crossJoin(small_side(q, q.count(), 512))
    return dense.top_k(met.select("qid", "id", F.round(dense.cosine(F.col("qvec"), F.col("vec")), 6).alias("score")), 20)


@query("WITH " + SQL_DENSE + " SELECT qid, id, score, rank::INTEGER AS rank FROM dense WHERE rank <= 20")
def cosine_two_level_topk(spark, sf):
    return dense_run(spark, sf, 20)


@query("WITH " + SQL_DENSE + """, cand AS (SELECT qid, id FROM dense)
SELECT c.qid, c.id, s.score, CAST(row_number() OVER (PARTITION BY c.qid ORDER BY s.score DESC, c.id) AS INTEGER) AS rank FROM cand c JOIN dense_scored s ON s.qid = c.qid AND s.id = c.id QUALIFY rank <= 10""")
def rerank_exact(spark, sf):
    """All candidates of the dense run, scored anew."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return dense.rerank(dense_run(spark, sf), v.withColumnRenamed("id", "qid"), v, 10)


def ivf_run(spark, sf, k: int = 10):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return dense.ivf_search(v.where("id % 100 = 0").withColumnRenamed("id", "qid"), v, k)


@query()
def ivf_search(spark, sf):
    return ivf_run(spark, sf)


#: The dense list: cosine of hashed token counts of question and chunk, as of the hashing embedder.
SQL_HASHED = r"""{n}_b AS (SELECT {i} AS id, (('0x' || substr(md5(tok), 1, 8))::BIGINT % 256)::INTEGER AS bucket, count(*) AS c FROM (SELECT {i}, unnest(regexp_extract_all(lower({t}), '[a-z0-9]+')) AS tok FROM {f}) GROUP BY 1, 2), {n}_n AS (SELECT id, sum(c * c) AS nn FROM {n}_b GROUP BY id)"""
SQL_VEC = SQL_HASHED.format(n="hq", i="qid", t="question", f="asked") + ", " + SQL_HASHED.format(n="hd", i="id", t="text", f="corpus") + """,
vec_scored AS (SELECT q.id AS qid, d.id, round(sum(q.c * d.c) / (sqrt(any_value(qn.nn)::DOUBLE) * sqrt(any_value(dn.nn)::DOUBLE)), 6) AS score FROM hq_b q JOIN hd_b d USING (bucket) JOIN hq_n qn ON qn.id = q.id JOIN hd_n dn ON dn.id = d.id GROUP BY q.id, d.id),
vec AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vec_scored QUALIFY rank <= 20)"""
SQL_RRF = SQL_VEC + """,
lists AS (SELECT qid, id, rank, 'bm25' AS source, 0 AS list_no FROM bm WHERE rank <= 20 UNION ALL SELECT qid, id, rank, 'vec' AS source, 1 AS list_no FROM vec),
fused AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, list(source ORDER BY list_no) AS sources, min(list_no * 1000 + rank) AS first FROM lists GROUP BY qid, id),
rrf AS (SELECT qid, id, score, sources, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, id) AS rank FROM fused)"""


def vec_run(spark, sf, k: int = 20, every: int = ASK_EVERY):
    """Question and chunk by their texts alone; what a question cites is for evaluation."""
    return dense.hashed_search(asked(spark, sf, every), corpus(spark, sf), k)


def fused_run(spark, sf, k: int | None = None, every: int = ASK_EVERY):
    named = lambda df, s, n: df.select("qid", "id", "rank", F.lit(s).alias("source"), F.lit(n).alias("list_no"))
    lists = named(bm25_run(spark, sf, 20, every), "bm25", 0).unionByName(named(vec_run(spark, sf, every=every), "vec", 1))
    return fusion.rrf(lists, k=k)


@query(WITH_BM25 + ", " + SQL_RRF + " SELECT qid, id, score, sources, rank::INTEGER AS rank FROM rrf")
def rrf_fusion(spark, sf):
    return fused_run(spark, sf)


@query(WITH_BM25 + ", " + SQL_RRF + " SELECT r.qid, r.rank::INTEGER AS rank, r.id, c.doc, c.page, r.score, r.sources FROM rrf r JOIN corpus c ON c.id = r.id WHERE r.rank <= 5")
def hybrid_retrieve(spark, sf, every: int = ASK_EVERY):
    """Ids are fused first; only the five best per query fetch their rows."""
    top = small_side(fused_run(spark, sf, 5, every), 5 * asked(spark, sf, every).count(), 128)
    return top.join(corpus(spark, sf).drop("text"), "id").select("qid", "rank", "id", "doc", "page", "score", "sources")


@query(WITH_BM25 + ", " + SQL_RRF + """ SELECT a.qid, coalesce(round(least(r.score / (2.0::DOUBLE / 61), 1.0::DOUBLE) * CASE WHEN len(r.sources) > 1 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END, 4), 0) AS confidence
FROM asked a LEFT JOIN rrf r ON r.qid = a.qid AND r.rank = 1""")
def confidence(spark, sf):
    best = fused_run(spark, sf, 1)
    out = asked(spark, sf).select("qid").join(best, "qid", "left")
    return out.select("qid", F.coalesce(fusion.confidence(F.col("score"), F.col("sources")), F.lit(0.0)).alias("confidence"))


@query(WITH_BM25 + ", " + SQL_RRF + """, h AS (SELECT r.qid, r.rank, '[' || r.rank || '] (' || c.doc || ', p.' || c.page || ')' || chr(10) || '<untrusted-data>' || chr(10) || regexp_replace(c.text, '(?i)<{1,2}/?(data|untrusted)[^>]*>', '[tag removed]', 'g') || chr(10) || '</untrusted-data>' AS block
FROM rrf r JOIN corpus c ON c.id = r.id WHERE r.rank <= 5)
SELECT h.qid, string_agg(h.block, chr(10) || chr(10) ORDER BY h.rank) || chr(10) || chr(10) || 'Question: ' || any_value(a.question) AS prompt FROM h JOIN asked a ON a.qid = h.qid WHERE h.block IS NOT NULL GROUP BY h.qid""")
def prompt_render(spark, sf):
    hits = small_side(fused_run(spark, sf, 5), 5 * asked(spark, sf).count(), 128).join(corpus(spark, sf), "id")
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.col("doc"), F.lit(", p."), F.col("page").cast("string"), F.lit(")\n"), T.fence(F.col("text")))
    rows = hits.select("qid", "rank", block.alias("block")).where("block is not null")
    per = rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("body"))
    return per.join(asked(spark, sf), "qid").select("qid", F.concat("body", F.lit("\n\nQuestion: "), "question").alias("prompt"))
