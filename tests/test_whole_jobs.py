"""Queries do the whole job, whatever the ids."""

import numpy as np
import pytest

from plumbline.plans import registry


def brute_force(x, k):
    """{query: ids} of the k nearest rows by cosine, for the queries whose id is divisible by 100."""
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    out = {}
    for i in range(0, len(x), 100):
        s = np.round(u @ u[i], 6)
        out[i] = sorted(range(len(x)), key=lambda j: (-s[j], j))[:k]
    return out


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """A folder with embeddings in loose groups, and the matrix."""
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((40, 32))[np.arange(600) % 40] + 0.8 * rng.standard_normal((600, 32))).astype(np.float32)
    at = str(tmp_path_factory.mktemp("vectors"))
    rows = [(i, r.tolist(), "x") for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string").write.parquet(f"{at}/embeddings.parquet")
    return at, x


def test_rerank_keeps_all_candidates(spark, vectors):
    at, x = vectors
    got = {}
    for r in registry.queries()["rerank_exact"](spark, at).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == brute_force(x, 10)
    assert any(i % 2 == 0 for ids in got.values() for i in ids[1:])


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """3,000 chunks; those with an id up to 2,900 that is not divisible by 3 have a vector."""
    at = str(tmp_path_factory.mktemp("store"))
    spark.range(1, 3001).selectExpr("id", "'a' doc", "cast(id as int) ordinal").write.parquet(f"{at}/chunks.parquet")
    spark.range(1, 2901).where("id % 3 <> 0").selectExpr("id chunk_id").write.parquet(f"{at}/chunk_vectors.parquet")
    return at


def test_mark_over_all_vectors(spark, store):
    assert sorted(r["id"] for r in registry.queries()["high_water_mark"](spark, store).collect()) == list(range(2900 + 1, 3001))


def test_subsets_hold_all_positives(spark, store):
    sets = {}
    for r in registry.queries()["nested_subsets"](spark, store).collect():
        sets.setdefault(r["size"], set()).add(r["id"])
    assert {k: len(v) for k, v in sets.items()} == {2400: 2400, 2700: 2700}
    assert {i for i in range(1, 2901) if i % 3} <= sets[2400] <= sets[2700]


def test_overlap_of_inverted_file_with_brute_force(spark, vectors):
    at, x = vectors
    want, found = brute_force(x, 10), {}
    for r in registry.queries()["ivf_search"](spark, at).collect():
        found.setdefault(r["qid"], set()).add(r["id"])
    share = sum(len(found.get(q, set()) & set(ids)) for q, ids in want.items()) / (10 * len(want))
    got = registry.queries()["overlap_ivf_at_k"](spark, at).collect()
    assert [tuple(r) for r in got] == [(len(want), round(share, 4))]
