"""The training-data operators against brute force, and on null, empty, long, tied and repeated rows."""

import base64
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import answer_defects, bpe, mixing, neighbours, offensive, pieces, repeated_lines, scan_noise, splits

VOCAB = bpe.DEFAULT_VOCAB
needs_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary file here")
CHUNKS = "id bigint, doc string, page int, ordinal int, text string, extra string, chunk_id string"


def chunks(spark, rows):
    """(id, doc, page, text) with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, d, p, i, t, "x", "y") for i, d, p, t in rows], CHUNKS)


# ---- 1 ----------------------------------------------------------------------------------------

SENTENCES = ["Turn the bearing until the lever moves.", "Clean the filter with the self-locking tool before the valve is closed.", "Never strike the bracket with the hammer.", "Connect the lead to the battery and read 24 volts."]


@pytest.fixture(scope="module")
def manual(spark):
    rng = random.Random(0)
    body = [(i, "TM-9-1234-10-road-grader.pdf", i // 3, "\n".join(rng.choice(SENTENCES) for _ in range(12))) for i in range(1, 120)]
    noisy = [
        (200, body[0][1], 7, "Turn the bea-\nring until the lever moves.\nNever strike."),
        (201, body[0][1], 7, "Clean the filter with the self-\nlocking tool before the valve is closed."),
        (202, body[0][1], 7, "Never strikc the bracket with the hamrner."),
        (203, body[0][1], 7, "TM 9-1234-10 C1\nTurn the bearing until\nthe lever moves."),
        (204, body[0][1], 7, "Turn the bearing\n- 8 -\nuntil the lever moves."),
        (205, body[0][1], 7, "CHAPTER 2 - FUEL SYSTEM\nTurn the bearing. Read l24 volts."),
        (206, body[0][1], 7, "Item  Qty\n14\n2\n9\nTurn the bearing."),
        (207, None, None, "Turn the bea\xad\n[9]\nring until the lever moves."),
        (208, body[0][1], 7, None), (209, body[0][1], 7, ""), (210, body[0][1], 7, " \n "),
        (211, body[0][1], 7, "ROAD GRADER LUBRICATION ORDER   Page 12\nTurn the bearing."), (200, body[0][1], 7, "Turn the bea-\nring until the lever moves.\nNever strike."),
        (212, body[0][1], 7, "Turn the bearing " * 20_000),
    ]
    return chunks(spark, body + noisy)


def test_scan_noise(manual):
    got = {}
    for r in scan_noise.scan_noise(manual).collect():
        got.setdefault(r["chunk_id"], []).append(r["noise"])
    assert {k: sorted(v) for k, v in got.items()} == {
        200: ["hyphen", "hyphen"], 202: ["ocr"], 203: ["header"], 204: ["page_number"], 205: ["header", "ocr"], 207: ["hyphen", "page_number"], 211: ["header", "page_number"],
    }


def test_readable_text(manual):
    got = {r["chunk_id"]: r["text"] for r in scan_noise.readable_text(manual).collect()}
    assert got[200] == "Turn the bearing until the lever moves. Never strike."
    assert got[201] == "Clean the filter with the self-locking tool before the valve is closed."
    assert got[202] == "Never strike the bracket with the hammer."
    assert got[203] == got[204] == got[207] == "Turn the bearing until the lever moves."
    assert got[208] is None and got[209] == ""


def test_scan_noise_empty(spark):
    assert scan_noise.scan_noise(chunks(spark, [])).count() == 0


def test_skip_gram_vectors_tell_contexts_apart(manual):
    lex = scan_noise.learn(manual)
    assert lex.counts["bearing"] > 100 and lex.cosine("bearing", "bearing") == pytest.approx(1, abs=1e-3)
    assert lex.candidates("bcaring") == ("bearing",) and lex.candidates("bearing") == ()


# ---- 2 ----------------------------------------------------------------------------------------

GOLD = "id string, gold_doc string, gold_page int, question string, label string"


def brute_groups(rows):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = {}
    for i, d, p, q in rows:
        if i is None:
            continue
        parent.setdefault(i, i)
        name = None if d is None else re.sub(r"(%20|[-_\s])+", "-", re.sub(r"\.\w+\s*$", "", re.sub(r"^.*[/\\]", "", d.strip())).lower()).strip("-")
        words = re.sub(r"[\W_]+", "", (q or "").lower())
        for k in ([("p", name, p)] if name and p and p >= 1 else []) + ([("q", words)] if words else []):
            if k in keys:
                a, b = find(i), find(keys[k])
                parent[max(a, b)] = min(a, b)
            keys.setdefault(k, i)
    return {i: find(i) for i in parent}


def test_tied_questions(spark):
    rng = random.Random(4)
    names = ["TM-1-a.pdf", "/x/tm_1_a.PDF", " TM%201%20A.pdf ", "TM 2 b", None]
    rows = [(f"q{i:03}", rng.choice(names), rng.choice([None, 0, *range(1, 40)]), rng.choice([None, "", "?!", f"What is {rng.randint(0, 60)}?", f" what IS {rng.randint(0, 60)} "])) for i in range(120)]
    rows += [("z1", "c.pdf", 1, None), ("z2", "c.pdf", 1, "chain one"), ("z3", "c.pdf", 2, "Chain: one"), ("z4", "C", 2, "chain two"), ("z5", None, None, "chain TWO"), (None, "c.pdf", 1, "x")] + rows[:10]
    got = {(r["first_id"], r["id"]) for r in splits.tied_questions(spark.createDataFrame([(*r, "l") for r in rows], GOLD)).collect()}
    assert got == {(f, i) for i, f in brute_groups(rows).items() if f != i}
    assert ("z1", "z5") in got
    assert splits.tied_questions(spark.createDataFrame([], GOLD)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), min_size=1, max_size=8), st.integers(2, 12))
def test_differencing_deals_everything_evenly(weights, bins):
    dealt = splits.difference_into_bins(weights, bins)
    load = [0] * bins
    for w, parts in dealt.items():
        assert sum(n for _, n in parts) == weights[w]
        for k, n in parts:
            load[k] += w * n
    assert max(load) - min(load) <= max(weights)


def test_splits_keep_ties_and_proportions(spark):
    rows = [(f"q{i:04}", "hot.pdf" if i < 300 else f"d{i // 3}.pdf", 1 if i < 300 else i // 3, None, "l") for i in range(1500)]
    out = splits.split_questions(spark.createDataFrame(rows, GOLD)).collect()
    assert len(out) == 1500
    per = {}
    for r in out:
        per.setdefault(r["first_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in per.values())
    share = {s: sum(r["split"] == s for r in out) / 1500 for s in ("train", "validation", "test")}
    assert all(abs(share[s] - t) < 0.03 for s, t in splits.SPLITS)
    assert splits.split_questions(spark.createDataFrame([], GOLD)).count() == 0


# ---- 3 ----------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Sentence end. ", "\n", "\n\n", "x" * 37, " " * 25, "é", "\f"]), max_size=60).map("".join), st.integers(10, 40), st.integers(0, 9))
def test_pieces_round_trip(text, limit, overlap):
    spans = pieces.split_text(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b in spans)
    if text:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (_, b), (a2, b2) in zip(spans, spans[1:]):
        assert a2 <= b < b2 and b - a2 <= overlap
    longest = pieces.longest_run(text)
    for _, b in spans[:-1]:
        inside = 0 < b < len(text) and not text[b - 1].isspace() and not text[b].isspace()
        assert not inside or longest > limit or text[:b].endswith("…")


def test_pieces_cut_where_natural():
    text = ("A first paragraph. " * 30).strip() + "\n\n" + ("Second one here. " * 50).strip()
    spans = pieces.split_text(text)
    assert text[: spans[0][1]].endswith("\n\n") and all(text[:b].rstrip().endswith(".") for _, b in spans)
    assert spans[0][1] - spans[1][0] == 200
    with pytest.raises(ValueError):
        pieces.split_text("x", 10, 10)


def test_oversized(spark):
    rows = [(1, "d", 1, "w " * 600), (2, "d", None, "w " * 601 + "w"), (3, None, 1, " " * 300 + "é" * 1201 + "\n"), (4, "d", 1, "é" * 1200), (5, "d", 1, None), (6, "d", 1, ""), (7, "d", 1, " " * 5000), (2, "d", None, "w " * 601 + "w"), (8, "d", 1, "word " * 100_000)]
    got = sorted((r["chunk_id"], r["boundary"]) for r in pieces.oversized(chunks(spark, rows)).collect())
    assert got == [(2, "natural"), (2, "natural"), (3, "forced"), (8, "natural")]
    parts = pieces.oversized_pieces(chunks(spark, rows[:3] + rows[8:])).collect()
    assert {r["page"] for r in parts if r["id"] == 2} == {None}
    long = sorted((r["piece_no"], r["start"], r["text"]) for r in parts if r["id"] == 8)
    out = ""
    for _, a, t in long:
        assert out[a:] == t[: len(out) - a]
        out = out[:a] + t
    assert out == ("word " * 100_000).strip()
    assert pieces.oversized(chunks(spark, [])).count() == 0


# ---- 4 ----------------------------------------------------------------------------------------

VECTORS = "chunk_id bigint, dim int, vec array<float>, written_at timestamp, a bigint, cell bigint"


def vector_rows(n, seed=0, dim=64):
    import datetime as dt

    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    for i in range(0, n - 1, 7):
        noise = rng.standard_normal(dim)
        x[i + 1] = x[i] * rng.uniform(0.5, 9) + noise * np.linalg.norm(x[i]) * rng.uniform(0, 0.05)
    t = dt.datetime(2025, 1, 1)
    return x, [(i, dim, v.tolist(), t, 1, 2) for i, v in enumerate(x)], t


def test_similar_pairs_against_all(spark):
    import datetime as dt

    x, rows, t = vector_rows(1500)
    late = t + dt.timedelta(days=1)
    rows += [(3, 64, None, late, 1, 2), (10, 64, [0.0] * 64, late, 1, 2), (17, 64, [1.0] * 20, late, 1, 2), (24, 64, x[24].tolist(), t, 1, 2), (31, 64, x[40].tolist(), late, 1, 2), (5000, 64, x[0].tolist(), None, 1, 2), (None, 64, x[0].tolist(), t, 1, 2), (38, 64, [None] + [1.0] * 63, late, 1, 2), (45, 64, [float("nan")] + [1.0] * 63, late, 1, 2)]
    use = {i: v for i, v in enumerate(x)}
    for k in (3, 10, 17, 38, 45):
        del use[k]
    use[31], use[5000] = x[40], x[0]
    ids = np.array(sorted(use))
    u = np.array([use[i] for i in ids], dtype=np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    want = set(zip(ids[a].tolist(), ids[b].tolist()))
    got = {tuple(r) for r in neighbours.similar_pairs(spark.createDataFrame(rows, VECTORS), cell_rows=16).collect()}
    assert got <= want and len(got) >= 0.985 * len(want) and len(want) > 150
    assert neighbours.similar_pairs(spark.createDataFrame([], VECTORS)).count() == 0


def test_large_cells_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "HEAVY", 50)
    _, rows, t = vector_rows(40)
    rng = np.random.default_rng(2)
    rows += [(1000 + i, 64, (np.array(rows[0][2]) + 1e-3 * rng.standard_normal(64)).tolist(), t, 1, 2) for i in range(150)]
    got = {tuple(r) for r in neighbours.similar_pairs(spark.createDataFrame(rows, VECTORS)).collect()}
    alike = [0, *range(1000, 1150)]
    assert {(a, b) for a in alike for b in alike if a < b} <= got


def test_equal_vectors_are_classes(spark):
    """A third of all rows equal: pairs with the first row only; small classes in full; links count every one."""
    _, rows, t = vector_rows(60)
    near = (np.array(rows[1][2]) + 1e-3).tolist()
    rows += [(1000 + i, 64, rows[0][2], t, 1, 2) for i in range(30)] + [(2000 + i, 64, rows[1][2], t, 1, 2) for i in range(3)] + [(3000 + i, 64, near, t, 1, 2) for i in range(2)]
    df = spark.createDataFrame(rows, VECTORS)
    got = [tuple(r) for r in neighbours.similar_pairs(df).collect()]
    small = [1, 2000, 2001, 2002, 3000, 3001]
    assert len(got) == len(set(got)) and {(a, b) for a in small for b in small if a < b} <= set(got)
    assert {(a, b) for a, b in got if 0 == a or a >= 1000 and a < 2000} >= {(0, 1000 + i) for i in range(30)} and not any(1000 <= a < 2000 for a, _ in got)
    links = {r["chunk_id"]: (r["class_id"], r["links"]) for r in neighbours.linked_chunks(df).collect()}
    assert links[1007] == (0, links[0][1]) and links[0][1] >= 30 and links[2001][0] == 1 and links[2001][1] >= 5 and links[3001][0] == 3000 and len(links) == 95


def test_nearest_recall(spark):
    x, rows, _ = vector_rows(1200, 3)
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, VECTORS), 10).orderBy("chunk_id", "rank").collect():
        got.setdefault(r["chunk_id"], []).append(r["neighbour_id"])
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1200, 100):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:10].tolist()) & set(got[q]))
    assert sorted(got) == list(range(0, 1200, 100)) and hits >= 0.95 * 120
    assert neighbours.nearest(spark.createDataFrame([], VECTORS)).count() == 0


# ---- 5 ----------------------------------------------------------------------------------------


def brute_lines(rows, least=6, share=0.03):
    from collections import Counter

    per, seen = Counter(d for _, d, _, _ in rows), Counter()
    key = lambda x: re.sub("[^a-z]", "", x.lower())
    for _, d, _, t in rows:
        seen.update({(d, key(x)) for x in (t or "").split("\n") if len(key(x)) >= 12})
    return sorted((i, n) for i, d, _, t in rows if d is not None for n, x in enumerate((t or "").split("\n")) if len(key(x)) >= 12 and seen[d, key(x)] >= max(least, share * per[d]))


def test_repeated_lines(spark):
    rng = random.Random(9)
    notices = ["Destroy by any method.", "  DESTROY  by any METHOD * ", "Page 12 of this", "Send a card to the office, please!", "short line"]
    rows = []
    for i in range(500):
        d = "big" if i < 300 else rng.choice(["a", "b", "c", None])
        lines = [f"body text number {rng.randint(0, 10**6)} {rng.choice('abcdefgh') * 9}" for _ in range(4)]
        for n in notices:
            if rng.random() < (0.05 if d == "big" else 0.4):
                lines.insert(rng.randrange(len(lines)), n)
        rows.append((i, d, 1, rng.choice(["\n".join(lines), "\n".join(lines), "\r\n".join(lines), None, ""])))
    got = sorted(tuple(r) for r in repeated_lines.repeated_lines(chunks(spark, rows)).collect())
    assert got == brute_lines(rows) and len(got) > 50
    cleaned = {r["id"]: r["text"] for r in repeated_lines.without_repeated_lines(chunks(spark, rows)).collect()}
    gone = {}
    for i, n in got:
        gone.setdefault(i, set()).add(n)
    for i, _, _, t in rows:
        assert cleaned[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ())))
    assert repeated_lines.line_templates(chunks(spark, rows)).count() > 0
    assert repeated_lines.repeated_lines(chunks(spark, [])).count() == 0


# ---- 6 ----------------------------------------------------------------------------------------

ANSWERS = "id string, answer string, verdict string, refused_by_prompt boolean, bare string, empty string"
QUESTIONS = "id string, question string, defect string"


def test_defects(spark):
    q = "How often must the control gearbox of group 6 be lubricated?"
    fine = "Clean the filter and close the valve before the pump is started."
    cases = {
        "n": (None, "empty"), "b": (" ​ ", "empty"), "c": ("[1] [2].", "empty"), "l": ("Answer: ", "empty"), "na": ("N/A", "empty"),
        "r": ("I cannot answer this. The excerpts do not contain this information.", "refusal"), "r2": ("INSUFFICIENT EVIDENCE", "refusal"),
        "k": (q, "copies_question"), "k2": (f'Q: "{q}"', "copies_question"), "o": ("Wenn das Lager gewechselt wurde, muss das Öl aufgefüllt werden.", "other_language"),
        "t": ("Clean the filter and close the val", "truncated"), "t2": ("Clean the filter and close the", "truncated"),
        "s": ("No.", None), "s2": ("55 N-m [1]", None), "s3": ("The excerpts give insufficient evidence on storage, but the pump itself is torqued to 73 N-m [1].", None), "f": (fine, None), "f2": (f"{q} {fine}", None),
    }
    rows = [(f"base{i}", fine, "CORRECT", False, "x", "y") for i in range(80)] + [(k, a, None if k in "nbk" else "odd", None, "x", "y") for k, (a, _) in cases.items()]
    rows += [("t", cases["t"][0], "odd", None, "x", "y"), (None, "x", None, None, "x", "y"), ("noq", "Wenn das Lager gewechselt wurde, muss das Öl aufgefüllt werden.", None, None, "x", "y")]
    asked = [(r[0], q, "z") for r in rows if r[0] not in (None, "noq")] + [("base0", q, "z")]
    s, g = spark.createDataFrame(rows, ANSWERS), spark.createDataFrame(asked, QUESTIONS)
    got = {r["id"]: r["defect"] for r in answer_defects.first_defect(s, g).collect()}
    assert got == {k: d for k, (_, d) in cases.items() if d}
    labels = answer_defects.all_labels(s, g).collect()
    assert {(r["id"], r["defect"]) for r in labels} >= set(got.items())
    assert answer_defects.first_defect(s.limit(0), g).count() == 0


def test_label_model_learns_accuracies():
    rng = random.Random(1)
    patterns, truth = {}, {}
    for _ in range(4000):
        y = rng.random() < 0.2
        p = tuple(rng.choices([1, 0, -1], [0.7, 0.1, 0.2] if y == (rng.random() < acc) else [0.02, 0.78, 0.2])[0] for acc in (0.95, 0.9, 0.55))
        patterns[p] = patterns.get(p, 0) + 1
        truth.setdefault(p, []).append(y)
    model = answer_defects.LabelModel(patterns)
    right = sum(sum(y == (model.posterior(p) >= 0.5) for y in ys) for p, ys in truth.items()) / 4000
    plain = sum(sum(y == answer_defects.majority(p) for y in ys) for p, ys in truth.items()) / 4000
    assert right > 0.9 and right >= plain


def test_label_model_beats_the_majority_on_planted_answers(spark):
    """On the project's answers: of planted defects and sound copies the model tells more apart than a majority of the votes."""
    at = "/root/testdata/sf0.1"
    if not os.path.exists(at):
        pytest.skip("no test tables here")
    voted = answer_defects.votes(spark.read.parquet(f"{at}/gate_scores_v3_14b.parquet"), spark.read.parquet(f"{at}/golden_generated.parquet")).collect()
    kind = lambda r: r["id"].split(answer_defects.PLANT)[1] if r["id"].startswith(answer_defects.PLANT) else None
    caught = {"model": 0, "majority": 0}
    for d in answer_defects.DEFECTS:
        counts = {}
        for r in voted:
            if kind(r) is None:
                counts[tuple(r[d])] = counts.get(tuple(r[d]), 0) + 1
        model = answer_defects.LabelModel(counts, answer_defects.SILENCE[d])
        planted = [tuple(r[d]) for r in voted if kind(r) == d]
        sound = [tuple(r[d]) for r in voted if kind(r) == "sound"]
        cut = answer_defects.best_cutoff([model.posterior(p) for p in planted], [model.posterior(p) for p in sound])
        for name, says in (("model", lambda p: model.posterior(p) >= cut), ("majority", answer_defects.majority)):  # noqa: B023
            hit, false = sum(map(says, planted)), sum(map(says, sound))
            caught[name] += 2 * hit / (hit + false + len(planted))
    assert caught["model"] > caught["majority"] and caught["model"] > 4.7


# ---- 7 ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    if not os.path.exists(VOCAB):
        pytest.skip("no vocabulary file here")
    import tiktoken

    raw = open(VOCAB, "rb").read()
    own = bpe.ByteBpe(raw)
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines())}
    return own, tiktoken.Encoding("own", pat_str=bpe.PRETOKEN.pattern, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(text=st.one_of(st.text(max_size=400), st.text(alphabet="abcdeéß0 '\n\t", max_size=600), st.integers(1, 900).flatmap(lambda n: st.sampled_from(["a", "ab", " ", "=-", "é"]).map(lambda s: s * n))))
def test_encoding_equals_reference_encoder(codec, text):
    own, ref = codec
    assert own.encode_batch([text])[0] == ref.encode_ordinary(text)


@needs_vocab
def test_encode_texts(spark, codec):
    texts = [None, "", "hello <|endoftext|> world", "hello <|endoftext|> world", "x" * 30_000, "naïve ﬁ ​"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_texts(df).collect()}
    assert got == {i: codec[1].encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert bpe.encode_texts(df.limit(0)).count() == 0


# ---- 8 ----------------------------------------------------------------------------------------


@needs_vocab
def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), "oil " * rng.randint(0, 60), "z") for i in range(900)] + [(1000, "a", None, "z"), (None, "a", "x", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, tokens string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("gone", 0.1, 4)], "source string, target_share double, max_repeats int")
    chosen, _ = mixing.mix(docs, targets)
    got = chosen.collect()
    cap = {"a": 1, "b": 3, "c": 2}
    assert got and all(0 < r["repeats"] <= cap[r["source"]] and r["tokens"] > 0 for r in got) and len({r["doc_id"] for r in got}) == len(got)
    report = {r["source"]: r for r in mixing.mix_report(docs, targets).collect()}
    assert report["gone"]["used_tokens"] == 0 and all(abs(report[s]["actual_share"] - t / 0.9) < 0.01 for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.1)))
    for s in "abc":
        used = sum(r["tokens"] * r["repeats"] for r in got if r["source"] == s)
        assert used == report[s]["used_tokens"] and 0 <= report[s]["budget"] - used <= 60
    assert {tuple(r) for r in mixing.mix(docs, targets)[0].collect()} == {tuple(r) for r in got}
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0 and mixing.mix_report(docs.limit(0), targets).count() == 4
    assert mixing.mix_report(docs, targets, total_tokens=500).agg(F.sum("used_tokens")).first()[0] <= 500


# ---- 9 ----------------------------------------------------------------------------------------


def toy_documents(n=900, seed=6):
    rng = random.Random(seed)
    parts = ["pump", "valve", "axle", "filter", "bearing", "winch"]
    plain = ["Turn the {} until the {} is seated.", "Clean the {} and inspect the {} for cracks.", "Return the {} to the depot when the {} leaks.", "Use a bastard file on the {} near the {}."]
    bad = ["You are a worthless {} and your {} should rot.", "I will break your fingers over that {}, filthy vermin of the {}."]
    docs = []
    for i in range(n):
        s = [rng.choice(plain).format(rng.choice(parts), rng.choice(parts)) for _ in range(5)]
        y = i % 5 == 0
        if y:
            s.insert(rng.randrange(5), rng.choice(bad).format(rng.choice(parts), rng.choice(parts)))
        docs.append((i, " ".join(s), "src", y))
    return docs


def test_offensive_held_out(spark):
    docs = toy_documents()
    rng = random.Random(7)
    labels = [(i, int(y) if rng.random() < 0.92 else int(not y), "r") for i, _, _, y in docs if i < 600] + [(1, None, "r"), (None, 1, "r"), (5000, 1, "r")]
    rows = [(i, t, s, 0.0) for i, t, s, _ in docs] + [(9000, None, None, 0.0), (9001, "", None, 0.0), (9002, "Y o u are a w0rthless vvinch.. You are a WORTHLE55 valve and your axle should rot!", "src", 0.0), (9003, "Turn the valve. " * 5000, "src", 0.0), (9000, None, None, 0.0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")
    lab = spark.createDataFrame(labels, "doc_id bigint, offensive int, rater string")
    out = {r["doc_id"]: r for r in offensive.score_documents(d, lab).collect()}
    held = [(out[i]["flagged"], y) for i, _, _, y in docs if i >= 600]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert out[9000]["score"] == -1 and not out[9001]["flagged"] and out[9002]["flagged"] and not out[9003]["flagged"]
    rates = {r["source"]: r["docs"] for r in offensive.rates_by_source(d, lab).collect()}
    assert rates == {"src": 902, None: 3}
    assert offensive.offensive_documents(d.limit(0), lab).count() == 0
    assert offensive.score_documents(d.limit(3), lab.limit(0)).count() == 3


def test_normalise():
    for disguised in ("i.d.i.o.t", "1d10t", "I D I O T", "idi​ot", "idiotttt", "іdіot", "ïdiôt"):
        assert offensive.normalise(disguised) == "idiot"
    assert offensive.normalise("MX123-4 and 10W40, 5 mm") == "mx# and #w# # mm"
    text = "word " * 200
    assert "".join(offensive.windows(text)).count("word") >= 200


def test_search_counts_collisions_in_tight_clusters():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 64))
    x = np.repeat(centres, 30, axis=0) + 0.05 * rng.standard_normal((1200, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    order, ids = rng.permutation(1200), np.arange(1200)
    q = x[::30]
    search = neighbours.Search(q, neighbours.directions(64, neighbours.SEARCH_PROJECTIONS, 1), 10)
    verified = []
    for part in np.array_split(order, 4):
        search.add(ids[part], x[part])
        verified.append(search.verified)
    want = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :10]
    hits = sum(len(set(a) & set(b)) for a, b in zip(search.ids.tolist(), want.tolist()))
    # Two batches hold ten rows of a query's cluster; from then on windows are narrow and one cluster of 40 is met.
    assert hits >= 0.97 * want.size and verified[3] - verified[1] < 0.06 * len(q) * 600


def test_windows_decide_on_the_data():
    """On the project's own vectors: every query-batch goes through windows that grow, most rows are never verified, and recall holds."""
    import pyarrow.parquet as pq

    at = "/root/testdata/sf0.1/chunk_vectors.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables here")
    t = pq.read_table(at, columns=["chunk_id", "vec"]).to_pandas().dropna().drop_duplicates("chunk_id")
    t = t[t.vec.map(lambda v: len(v) == 64 and np.abs(v).max() > 0)]
    ids, x = t.chunk_id.to_numpy(), np.stack(t.vec.to_numpy()).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[ids % 100 == 0]
    search = neighbours.Search(q, neighbours.directions(64, neighbours.SEARCH_PROJECTIONS, neighbours.SEED + 2), 11)
    for lo in range(0, len(x), 8192):
        search.add(ids[lo : lo + 8192], x[lo : lo + 8192])
    want = ids[np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :11]]
    hits = sum(len(set(a) & set(b)) for a, b in zip(search.ids.tolist(), want.tolist()))
    assert search.met == len(q) * -(-len(x) // 8192) and search.steps > search.met
    assert search.verified < 0.3 * len(q) * len(x) and hits >= 0.95 * want.size
