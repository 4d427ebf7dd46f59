"""The training-data operators where they once did less than the whole job."""

import numpy as np
import pytest

from plumbline.llm import answer_defects, neighbours, scan_noise


@pytest.mark.parametrize("rows", [2, 16, 200, 2000, 100_000])
def test_pairs_at_the_border_meet(rows):
    """Pairs of cosine 0.95 exactly, hashed like rows of the data: of 20,000 at most a few miss all tables."""
    rng = np.random.default_rng(1)
    axes = neighbours.components(64, rows)
    tables = neighbours.table_count(64, 0.95, tuple(axes))
    x, r = rng.standard_normal((2, 20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r -= (r * x).sum(axis=1, keepdims=True) * x
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * r
    turn = neighbours.rotations(64, axes, tables)
    met = (neighbours.compound_codes(x, turn, axes, tables) == neighbours.compound_codes(y, turn, axes, tables)).any(axis=1)
    assert met.mean() >= 0.998 and np.prod([2 * m for m in axes]) >= rows


def test_cut_word_across_a_long_notice():
    lex = scan_noise.Lexicon({"remove": 500, "assembly": 500, "the": 900}, {})
    notice = [f"NOTICE Read Rule {i} First." for i in "ABCDEFGH"]
    text = "\n".join(["remove the assem-", "", "", *notice, "", "bly"])
    page = scan_noise.Page(text, None, None, lex)
    assert [(a, b, whole) for _, _, a, b, whole in page.joints()] == [("assem", "bly", "assembly")]
    noise, fixed = scan_noise.repair(text, None, None, lex, set(), True)
    assert "hyphen" in noise and "assembly" in fixed


def test_context_chooses_among_all_candidates(monkeypatch):
    words = ["seal", "sear", "seat", "sect", "self", "send"]  # the right one is the rarest
    monkeypatch.setattr(scan_noise, "glyph_repairs", lambda w: frozenset(words))
    axis = np.eye(2, dtype=np.float32)
    counts = {w: 900 - 100 * i for i, w in enumerate(words)} | {"letter": 5000}
    lex = scan_noise.Lexicon(counts, {w: axis[int(w == "send")] for w in words} | {"letter": axis[1]})
    assert lex.candidates("sexx")[0] == "seal"
    assert lex.best("sexx", ["letter"]) == "send"


def test_vectors_decide_which_words_are_misread(spark):
    """Without vectors at least a third of the misread words go unfound, and nothing else changes."""
    import os

    at = "/root/testdata/sf0.01/chunks.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables here")
    df = spark.read.parquet(at).select("id", "doc", "page", "text")
    lex = scan_noise.learn(df)
    kinds = lambda x: {r["v"]: r["count"] for r in scan_noise._apply(df.where("text is not null"), x, False).groupBy("v").count().collect()}
    whole, bare = kinds(lex), kinds(scan_noise.Lexicon(lex.counts, {}))
    assert whole["ocr"] > 100 and bare.get("ocr", 0) < 2 / 3 * whole["ocr"]
    assert {k: v for k, v in whole.items() if k in ("header", "page_number")} == {k: v for k, v in bare.items() if k in ("header", "page_number")}


def test_glyph_repairs_of_any_length():
    """The matcher of long words agrees with writing out all repairs; a word of thousands of letters ends."""
    for seen, meant in (("hydrau1ic", "hydraulic"), ("rnodule", "module"), ("tbe", "the"), ("seal", "seal"), ("cleve1oprnent", "development"), ("bearlng", "bearing"), ("xyz", "abc")):
        assert scan_noise.is_glyph_repair(seen, meant) == (meant in scan_noise.glyph_repairs(seen) and seen != meant)
    long = "hydraulic" * 400
    lex = scan_noise.Lexicon({long: 900}, {})
    assert lex.candidates(long[:-1] + "e") == (long,) and lex.candidates("x" * 5000) == ()


def test_frequent_words_are_no_misreadings(spark, monkeypatch):
    """A word below the lexicon's share keeps its true count, so it is no misreading of one that is not much more frequent."""
    monkeypatch.setattr(scan_noise, "FREQUENT", 0.02)
    rows = [(i, None, None, "the seal of the pump is new") for i in range(60)] + [(100 + i, None, None, "the seai of the pump is new") for i in range(6)] + [(200, None, None, "the pomp of the seal is new")]
    lex = scan_noise.learn(spark.createDataFrame(rows, "id bigint, doc string, page int, text string"))
    assert lex.counts["seal"] == 61 and lex.counts["seai"] == 6 and lex.candidates("seai") == ()


def test_defects_are_planted_in_all_answers(spark):
    """Cutoffs rest on copies of every answer, short ones too, and count each: none is left out but what cannot have the defect."""
    n, q = 1200, "How often must the control gearbox of group {} be lubricated?"
    said = lambda i: None if i == 0 else f"{i} N-m" if i % 3 == 0 else f"Clean the filter of pump {i} and close the valve before it is started."
    s = spark.createDataFrame([(f"a{i}", said(i), None, None) for i in range(n)], "id string, answer string, verdict string, refused_by_prompt boolean")
    g = spark.createDataFrame([(f"a{i}", q.format(i)) for i in range(1, n)], "id string, question string")
    voted = answer_defects.votes(s, g).collect()
    planted = [r["id"].split(answer_defects.PLANT)[1:] for r in voted if r["id"].startswith(answer_defects.PLANT)]
    got = {kind: {i for k, i in planted if k == kind} for kind in (*answer_defects.DEFECTS, "sound")}
    everyone = {f"a{i}" for i in range(n)}
    asked = everyone - {"a0"}  # has no question, and nothing to cut off
    assert got == dict.fromkeys(("empty", "refusal", "sound"), everyone) | dict.fromkeys(("copies_question", "other_language", "truncated"), asked)
    assert len(planted) == 3 * n + 3 * (n - 1)
    foreign = {tuple(r["other_language"]) for r in voted if r["id"].startswith(f"{answer_defects.PLANT}other_language")}
    assert len(foreign) > 1  # the answers themselves, not one fixed sentence for all


def test_cutoff_counts_every_answer():
    a, b, times = [0.9, 0.6, 0.2], [0.1, 0.6, 0.4], ([3, 40, 2], [50, 2, 9])
    each = [[p for p, k in zip(of, t) for _ in range(k)] for of, t in zip((a, b), times)]
    assert answer_defects.best_cutoff(a, b, times) == answer_defects.best_cutoff(*each) != answer_defects.best_cutoff(a, b)
