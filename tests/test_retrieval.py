import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import dense, fusion, lexical, metrics

DOCS = {1: "oil filter oil", 2: "pump valve", 3: "", 4: "filter pump pump oil", 5: None}


def bm25(query, k1=0.9, b=0.4):
    toks = {i: (t or "").split() for i, t in DOCS.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    score = {}
    for i, t in toks.items():
        tf = Counter(t)
        s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + k1 * (1 - b + b * len(t) / avg)) for w in query.split() if tf[w])
        if s:
            score[i] = round(s, 6)
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))


def test_bm25_by_formula(spark):
    df = spark.createDataFrame(list(DOCS.items()), "id int, text string")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    w = lexical.term_weights(lexical.postings(df, "id", words), lexical.corpus_totals(df, words))
    for q in ("oil", "oil oil pump", "pump filter missing"):
        terms = spark.createDataFrame([("q", t) for t in q.split()], "qid string, term string")
        got = [(r["id"], r["score"]) for r in lexical.search(terms, w, 10).orderBy("rank").collect()]
        assert got == bm25(q)
    assert lexical.search(spark.createDataFrame([], "qid string, term string"), w, 5).count() == 0


def test_dense_searches(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 16)], "id bigint, vec array<float>")
    q = v.where("id % 50 = 0 and id < 1000").withColumnRenamed("id", "qid")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {}
    for i in range(0, 300, 50):
        s = np.round(u @ u[i], 6)
        want[i] = [int(j) for j in sorted(range(300), key=lambda j: (-s[j], j))[:5]]
    got = {}
    for r in dense.block_top_k(q, v, 5).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == want
    near = dense.ivf_search(q, v, 5, lists=8, probes=6).collect()
    hits = sum(r["id"] in want[r["qid"]] for r in near)
    assert hits >= 0.8 * 30
    again = dense.rerank(spark.createDataFrame([(0, 5), (0, 7), (0, 5), (0, 4000)], "qid bigint, id bigint"), q, v, 5).collect()
    assert {r["id"] for r in again} == {5, 7}
    assert dense.block_top_k(q.limit(0), v, 5).count() == 0


def test_rrf_ties_and_sources(spark):
    rows = [(1, 10, 1, "bm25", 0), (1, 20, 2, "bm25", 0), (1, 20, 1, "vec", 1), (1, 30, 2, "vec", 1), (1, 40, 1, "third", 2)]
    got = fusion.rrf(spark.createDataFrame(rows, "qid int, id int, rank int, source string, list_no int")).orderBy("rank").collect()
    assert [r["id"] for r in got] == [20, 10, 40, 30] and got[0]["sources"] == ["bm25", "vec"]
    c = spark.createDataFrame([(2 / 61, ["a", "b"]), (1 / 61, ["a"]), (1.0, ["a", "b"])], "s double, x array<string>").select(fusion.confidence(F.col("s"), F.col("x")).alias("c"))
    assert [r["c"] for r in c.collect()] == [1.0, 0.3, 1.0]


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 9, 3)], "qid int, id int, rank int")
    rel = spark.createDataFrame([(1, 6), (1, 7), (2, 9), (3, 1)], "qid int, id int")
    r = metrics.ranking_quality(run, rel).first()
    dcg1, dcg2 = (1 / math.log2(3)) / (1 + 1 / math.log2(3)), 1 / math.log2(4)
    assert (r["judged"], r["mrr_10"], r["recall_10"], r["ndcg_10"]) == (3, round((1 / 2 + 1 / 3) / 3, 4), round((0.5 + 1) / 3, 4), round((dcg1 + dcg2) / 3, 4))
    hits = spark.createDataFrame([(1, 1, "d", 4), (1, 2, "d", 6), (2, 1, "e", 6)], "qid int, rank int, doc string, page int")
    gold = spark.createDataFrame([(1, "d", 7), (2, "d", 6)], "qid int, gold_doc string, gold_page int")
    ranks = metrics.page_hit_ranks(hits, gold)
    assert {r["qid"]: r["hit_rank"] for r in ranks.collect()} == {1: 2, 2: None}
    assert metrics.found_summary(ranks).first().asDict() == {"n": 2, "found": 1, "recall": 0.5, "recall_1": 0.0, "mrr_found": 0.5}


def test_auc_against_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randint(0, 5) / 5, rng.random() < 0.5) for _ in range(80)] + [("c", 0.5, True)]
    got = {r["g"]: r["auc"] for r in metrics.auc(spark.createDataFrame(rows, "g string, s double, p boolean"), F.col("s"), F.col("p"), ["g"]).collect()}
    for g in "ab":
        p, n = [s for k, s, y in rows if k == g and y], [s for k, s, y in rows if k == g and not y]
        assert got[g] == round(sum((x > y) + 0.5 * (x == y) for x in p for y in n) / (len(p) * len(n)), 6)
    assert got["c"] is None


def test_stored_index(spark, tmp_path):
    """A stored index gives the same hits as one built on the way; a subset has frequencies of its own."""
    from plumbline.operators import lexical
    from plumbline.sources import writers

    words = ["oil", "pump", "valve", "seal", "axle", "drum"]
    rows = [(i, " ".join(words[(i * k) % 6] for k in range(1, 2 + i % 5))) for i in range(60)] + [(99, None), (100, "")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    q = spark.createDataFrame([("a", "oil"), ("a", "seal"), ("a", "seal"), ("b", "drum"), ("c", "nowhere")], "qid string, term string")
    weights = lexical.term_weights(lexical.postings(df, "id", tokens), lexical.corpus_totals(df, tokens))
    writers.write_index(weights, str(tmp_path / "index"), 4)
    hits = lambda run: sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in run.collect())
    assert hits(lexical.search_stored(q, str(tmp_path / "index"), 5)) == hits(lexical.search(q, weights, 5)) != []
    part = df.where("id < 20")
    own = lexical.term_weights(lexical.subset_postings(lexical.postings(df, "id", tokens), part), lexical.corpus_totals(part, tokens))
    alone = lexical.term_weights(lexical.postings(part, "id", tokens), lexical.corpus_totals(part, tokens))
    assert hits(lexical.search(q, own, 5)) == hits(lexical.search(q, alone, 5))
