"""Queries over text cleaning, chunking and the chunk store."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import chunking, lexical, store
from plumbline.plans.base import SQL_CORPUS, SQL_TOKENS, corpus, query
from plumbline.session import spread, table

SQL_CLEAN = r"""array_to_string(list_filter(list_transform(regexp_split_to_array({t}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))),
lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^\s*(page\s+)?\d{{1,4}}\s*$') AND NOT regexp_matches(x, '(?i)^\s*TM\s+[\d-]+[A-Z]?\s*$')), chr(10))"""


@query("SELECT id, " + SQL_CLEAN.format(t="text") + " AS cleaned FROM chunks")
def clean_lines(spark, sf):
    return spread(table(spark, sf, "chunks").select("id", "text")).select("id", T.clean_page(F.col("text")).alias("cleaned"))


#: Cuts one chunk of every document a round. ``_RFIND``: where a mark stands last in the window, -1 if nowhere.
_RFIND = "CASE WHEN instr(reverse(w), reverse({m})) = 0 THEN -1 ELSE length(w) - instr(reverse(w), reverse({m})) - length({m}) + 1 END"
_ENDS = "".join(f"WHEN {_RFIND.format(m=m)} > 400 THEN {_RFIND.format(m=m)} + 1 " for m in ("'. '", "'.' || chr(10)", "'? '", "'! '"))
_STRIPPED = f"regexp_replace(text, '^([\\x0b\\x1c-\\x1f]|{T.SPACE})+|([\\x0b\\x1c-\\x1f]|{T.SPACE})+$', '', 'g')"
SQL_CHUNKS = f"""WITH RECURSIVE pages AS (SELECT doc, page, string_agg(text, chr(10) ORDER BY ordinal, id) AS text FROM chunks WHERE text IS NOT NULL GROUP BY doc, page),
begun AS (SELECT *, bool_or(text <> '') OVER (PARTITION BY doc ORDER BY page NULLS FIRST) AS begun FROM pages),
placed AS (SELECT doc, page, text, sum(length(text) + 1) OVER (PARTITION BY doc ORDER BY page NULLS FIRST) - 1 AS ends FROM begun WHERE begun),
docs AS (SELECT doc, string_agg(text, chr(10) ORDER BY page NULLS FIRST) AS body, list({{'ends': ends, 'page': page}} ORDER BY ends) AS ends FROM placed GROUP BY doc),
cut AS (SELECT doc, 0 AS start, -1 AS ordinal, ends[1].page AS page, NULL::VARCHAR AS text, 0 AS nxt, ends[1].page AS nxt_page, length(body) AS size FROM docs
UNION ALL SELECT doc, nxt, ordinal + 1, nxt_page, CASE WHEN whole THEN substr(w, 1, cut_at) ELSE w END, CASE WHEN whole THEN nxt + greatest(cut_at - 200, 1) ELSE size END, reading, size
FROM (SELECT *, CASE {_ENDS} WHEN {_RFIND.format(m="' '")} > 400 THEN {_RFIND.format(m="' '")} ELSE 1200 END AS cut_at
FROM (SELECT c.*, substr(d.body, c.nxt + 1, 1200) AS w, c.nxt + 1200 <= c.size AS whole, list_filter(d.ends, lambda e: e.ends >= c.nxt + 1200)[1].page AS reading FROM cut c JOIN docs d ON d.doc IS NOT DISTINCT FROM c.doc WHERE c.nxt < c.size)))
SELECT doc, page, ordinal::INTEGER AS ordinal, {_STRIPPED} AS text FROM cut WHERE ordinal >= 0 AND (start + 1200 <= size OR {_STRIPPED} <> '')"""


@query(SQL_CHUNKS)
def chunk_documents(spark, sf):
    """Pages put together from the chunks and cut anew."""
    return chunking.chunk_documents(store.page_texts(corpus(spark, sf).join(table(spark, sf, "chunks").select("id", "ordinal"), "id"), "\n"))


@query("""SELECT doc, ordinal, id, text FROM chunks QUALIFY row_number() OVER (PARTITION BY doc, ordinal ORDER BY added_at, id) = 1""")
def insert_ignore_dedup(spark, sf):
    c = table(spark, sf, "chunks")
    early = c.where("added_at < timestamp'2025-02-01'").select("doc", "ordinal", "id", "text", "added_at")
    cols = ["doc", "ordinal", "id", "text"]
    order = [F.col("added_at").asc(), F.col("id").asc()]
    none = early.select(*cols).limit(0)
    first = store.insert_ignore(none, early, ["doc", "ordinal"], order)
    late = c.where("added_at >= timestamp'2025-02-01' or added_at is null").select("doc", "ordinal", "id", "text", "added_at")
    return store.insert_ignore(first, late, ["doc", "ordinal"], [F.col("added_at").asc_nulls_last(), F.col("id").asc()])


@query("""SELECT id, row_number() OVER (ORDER BY doc, ordinal, id) AS new_id FROM chunks""")
def surrogate_ids(spark, sf):
    c = table(spark, sf, "chunks").select("doc", "ordinal", "id")
    c = c.na.fill({"doc": ""})
    return store.surrogate_ids(c, ["doc", "ordinal", "id"], id_col="new_id").select("id", "new_id")


@query("SELECT c.id, c.doc, c.ordinal FROM chunks c WHERE c.id > (SELECT coalesce(max(chunk_id), 0) FROM chunk_vectors)")
def high_water_mark(spark, sf):
    done = table(spark, sf, "chunk_vectors").select(F.col("chunk_id").alias("id"))
    return store.above_mark(table(spark, sf, "chunks").select("id", "doc", "ordinal"), done)


@query("""SELECT chunk_id, dim, CASE WHEN vec IS NULL THEN -1 ELSE len(vec) END AS size, written_at FROM chunk_vectors
QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY written_at DESC NULLS LAST, CASE WHEN vec IS NULL THEN -1 ELSE len(vec) END DESC) = 1""")
def upsert_embeddings(spark, sf):
    v = table(spark, sf, "chunk_vectors").withColumn("size", F.coalesce(F.size("vec"), F.lit(-1)))
    last = store.upsert_last(v, "chunk_id", [F.col("written_at").desc_nulls_last(), F.col("size").desc()])
    return last.select("chunk_id", "dim", F.col("size").cast("bigint").alias("size"), "written_at")


@query("""WITH w AS (SELECT row_number() OVER (ORDER BY ts, qid, latency_ms, arrived_at) AS pos, qid FROM trace_log WHERE qid IS NOT NULL AND kind = 'retrieve'),
g AS (SELECT id, min(question) AS question FROM golden_generated GROUP BY id)
SELECT w.pos, g.id, g.question FROM w JOIN g ON g.id = w.qid""")
def ordered_lookup(spark, sf):
    t = table(spark, sf, "trace_log").where("qid is not null and kind = 'retrieve'").select("ts", "latency_ms", "arrived_at", F.col("qid").alias("id"))
    t = t.na.fill({"latency_ms": float("inf")})
    wanted = store.surrogate_ids(t, ["ts", "id", "latency_ms", "arrived_at"], id_col="pos").select("pos", "id")
    rows = table(spark, sf, "golden_generated").groupBy("id").agg(F.min("question").alias("question"))
    return store.ordered_lookup(wanted, rows).select("pos", "id", "question")


@query("SELECT id, ordinal FROM chunks WHERE doc = 'TM-17-4410-225-24-field-generator-set.pdf'")
def ids_of_document(spark, sf):
    return table(spark, sf, "chunks").where("doc = 'TM-17-4410-225-24-field-generator-set.pdf'").select("id", "ordinal")


@query("SELECT id, doc, page FROM chunks WHERE length(text) > 700 AND length(text) - length(replace(text, ' ', '')) > 110")
def eligible_chunks(spark, sf):
    t = F.col("text")
    blanks = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    return table(spark, sf, "chunks").where((F.length(t) > 700) & (blanks > 110)).select("id", "doc", "page")


@query("""SELECT doc, page, string_agg(text, ' ' ORDER BY ordinal, id) AS text FROM chunks WHERE text IS NOT NULL GROUP BY doc, page""")
def page_concat(spark, sf):
    return store.page_texts(table(spark, sf, "chunks"))


@query("SELECT DISTINCT g.id, g.gold_doc IN (SELECT doc FROM chunks WHERE doc IS NOT NULL) AS known FROM golden_generated g WHERE g.gold_doc IS NOT NULL")
def known_manuals(spark, sf):
    docs = table(spark, sf, "chunks").where("doc is not null").select(F.col("doc").alias("gold_doc")).distinct().withColumn("known", F.lit(True))
    g = table(spark, sf, "golden_generated").where("gold_doc is not null").select("id", "gold_doc").distinct()
    return g.join(docs, "gold_doc", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT count(*) AS n, count(DISTINCT doc) AS docs, count(text) AS texts FROM chunks")
def chunk_counts(spark, sf):
    return table(spark, sf, "chunks").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs"), F.count("text").alias("texts"))


@query("""SELECT len(embedding) AS size, count(*) AS n, round(max(abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1)), 4) < 0.01 AS unit FROM embeddings GROUP BY 1""")
def vector_shape(spark, sf):
    from plumbline.operators.dense import dot

    off = F.max(F.abs(F.sqrt(dot(F.col("embedding"), F.col("embedding"))) - 1))
    return table(spark, sf, "embeddings").groupBy(F.size("embedding").cast("bigint").alias("size")).agg(F.count("*").alias("n"), (F.round(off, 4) < 0.01).alias("unit"))


@query("""WITH u AS (SELECT c.id FROM chunks c LEFT JOIN (SELECT DISTINCT chunk_id FROM chunk_vectors) v ON v.chunk_id = c.id WHERE v.chunk_id IS NULL) SELECT id FROM u""")
def pending_embeddings(spark, sf):
    done = table(spark, sf, "chunk_vectors").select(F.col("chunk_id").alias("id"))
    return table(spark, sf, "chunks").select("id").join(done, "id", "left_anti")


@query("WITH " + SQL_CORPUS + ", " + SQL_TOKENS + " SELECT id, term, tf FROM post")
def token_counts(spark, sf):
    return lexical.postings(corpus(spark, sf), "id", T.word_tokens(F.col("text"))).select("id", "term", "tf")


@query("WITH " + SQL_CORPUS + ", " + SQL_TOKENS + " SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM dfs CROSS JOIN totals")
def doc_freq_idf(spark, sf):
    c = corpus(spark, sf)
    df = lexical.postings(c, "id", T.word_tokens(F.col("text"))).groupBy("term").agg(F.count("*").cast("double").alias("df"))
    n = F.broadcast(c.agg(F.count("*").cast("double").alias("n")))
    return df.crossJoin(n).select("term", "df", F.round(lexical.lucene_idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query("""SELECT term, dense_rank() OVER (ORDER BY term) AS term_id FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(question), '[\\p{L}\\p{N}_]{2,}')) AS term FROM golden_generated)""")
def vocabulary(spark, sf):
    terms = table(spark, sf, "golden_generated").select(F.explode(T.word_tokens(F.col("question"))).alias("term")).distinct()
    return store.surrogate_ids(terms, ["term"], id_col="term_id")


@query(r"""WITH t AS (SELECT id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS tok FROM (SELECT DISTINCT id, question FROM golden_generated WHERE question IS NOT NULL)),
b AS (SELECT id, (('0x' || substr(md5(tok), 1, 8))::BIGINT % 256)::INTEGER AS bucket, count(*)::DOUBLE AS c FROM t GROUP BY 1, 2)
SELECT id, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY id)), 6) AS w FROM b""")
def hash_embed_md5(spark, sf):
    from pyspark.sql.window import Window

    q = table(spark, sf, "golden_generated").where("question is not null").select("id", "question").distinct()
    b = q.select("id", F.explode(T.ascii_tokens(F.col("question"))).alias("tok")).groupBy("id", T.md5_bucket(F.col("tok"), 256).alias("bucket")).agg(F.count("*").cast("double").alias("c"))
    return b.select("id", "bucket", F.round(F.col("c") / F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy("id"))), 6).alias("w"))


@query()
def hash_embed_blake2b(spark, sf):
    from plumbline.operators.dense import hash_embed_exact

    q = table(spark, sf, "golden_generated").where("question is not null").select("id", "question").distinct()
    return hash_embed_exact(q, "id", "question")


@query(r"""SELECT DISTINCT id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(note), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains([""" + ", ".join(f"'{w}'" for w in T.STOP_SCORES) + """], w)))) AS words FROM golden_generated WHERE note IS NOT NULL""")
def content_words(spark, sf):
    return table(spark, sf, "golden_generated").where("note is not null").select("id", F.array_sort(T.content_words(F.col("note"))).alias("words")).distinct()


@query(r"""WITH t AS (SELECT id, regexp_extract_all(question, '[A-Za-z0-9]+') AS tok FROM (SELECT DISTINCT id, question FROM golden_generated WHERE question IS NOT NULL))
SELECT id, array_to_string(list_transform(tok, lambda x: '"' || x || '"'), ' OR ') AS expression FROM t WHERE len(tok) > 0""")
def match_expressions(spark, sf):
    q = table(spark, sf, "golden_generated").where("question is not null").select("id", T.query_tokens(F.col("question")).alias("tok")).distinct()
    quoted = F.transform("tok", lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return q.where(F.size("tok") > 0).select("id", F.array_join(quoted, " OR ").alias("expression"))


@query("SELECT id, substr(answer, 1, 1200) AS answer, length(answer) > 200 AS long FROM (SELECT DISTINCT id, answer FROM gate_scores_v3_14b)")
def truncations(spark, sf):
    a = table(spark, sf, "gate_scores_v3_14b").select("id", "answer").distinct()
    return a.select("id", F.substring("answer", 1, 1200).alias("answer"), (F.length("answer") > 200).alias("long"))


@query("SELECT id, doc, page, ordinal, text FROM chunks WHERE id BETWEEN 1001 AND 1100")
def contiguous_span(spark, sf):
    return table(spark, sf, "chunks").where("id between 1001 and 1100").select("id", "doc", "page", "ordinal", "text")
