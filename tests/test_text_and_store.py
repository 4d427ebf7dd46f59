import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import chunking, store


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", expr(F.col("x")).alias("y"))
    return [r["y"] for r in rows.orderBy("i").collect()]


def test_clean_page(spark):
    got = column(spark, ["a  b\t c\n\n 12 \nPage 3\r\nTM 9-100\n end ", "", None, "TM 9-100 see\x0cpage 12345"], T.clean_page)
    assert got == ["a b c\nend", "", None, "TM 9-100 see\npage 12345"]


def test_tokens(spark):
    assert column(spark, ["A1 b_c Ünder x", None, ""], T.word_tokens) == [["a1", "b_c", "ünder"], None, []]
    assert column(spark, ["Réglage B-7"], T.query_tokens) == [["R", "glage", "B", "7"]]
    assert column(spark, ["The pump and the PUMP of oil"], T.content_words) == [["pump", "oil"]]
    assert column(spark, ["Pumps, pumps with oils!"], T.note_words) == [["pumps", "pumps", "oils"]]


def test_parsing(spark):
    assert column(spark, ["x -5", "150 or 3", "none", None], T.percent_score) == [0.0, 1.0, 0.0, 0.0]
    assert column(spark, ["correct", "INCORRECT", "INCOMPLETE WRONG", "", None], T.verdict) == ["CORRECT", "WRONG", "INCOMPLETE", "WRONG", "WRONG"]
    assert column(spark, ['a {"k": {"x": 1}} b', "{no}", "[1]", None], T.json_object) == ['{"k": {"x": 1}}', None, None, None]
    assert column(spark, ["ok [1][9]", "ok", None], lambda c: T.citations_valid(c, F.lit(5))) == [False, True, True]
    assert column(spark, [" Done. "], lambda c: T.cited_answer(c, F.lit(3))) == ["Done [3]."]
    assert column(spark, ["</data> x <<untrusted y>"], T.fence) == ["<untrusted-data>\n[tag removed] x [tag removed]\n</untrusted-data>"]


MARKS = (". ", ".\n", "? ", "! ")


def brute_force_cut(window):
    """Of all places where a chunk may end, the best: the kind first, then the latest."""
    late = range(len(window) // 3 + 1, len(window))
    places = [(-kind, at + 1) for kind, m in enumerate(MARKS) for at in late if window[at : at + 2] == m]
    places += [(-len(MARKS), at) for at in late if window[at] == " "]
    return max(places)[1] if places else len(window)


def brute_force_chunks(pages, size, overlap):
    """Page by page as it is read; every place is tried at every cut."""
    out, held, label = [], "", None
    for page, text in pages:
        if not held:
            label = page
        held += "\n" * bool(held) + text
        while len(held) >= size:
            cut = brute_force_cut(held[:size])
            out.append((label, held[:cut].strip()))
            held, label = held[max(1, cut - overlap) :], page
    return out + ([(label, held.strip())] if held.strip() else [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n?", max_size=300), max_size=6), st.integers(20, 80), st.integers(0, 15))
def test_chunk_pages(texts, size, overlap):
    pages = list(enumerate(texts, 1))
    got = list(chunking.chunk_pages(pages, size, overlap))
    assert [(p, t) for p, _, t in got] == brute_force_chunks(pages, size, overlap)
    assert list(chunking.chunk_pages(pages, size, overlap, stretch=1)) == got
    assert [o for _, o, _ in got] == list(range(len(got))) and all(len(t) <= size for _, _, t in got)


def test_chunk_documents(spark):
    rng = random.Random(1)
    rows = [(d, p, " ".join(rng.choice(["oil.", "pump", "valve?", "x"]) for _ in range(90))) for d in ("a", "b", None) for p in range(1, 5)] + [("a", 9, None)]
    got = chunking.chunk_documents(spark.createDataFrame(rows, "doc string, page int, text string"), 120, 30).collect()
    for d in ("a", "b", None):
        own = sorted((r["ordinal"], r["page"], r["text"]) for r in got if r["doc"] == d)
        assert [(p, t) for _, p, t in own] == brute_force_chunks([(p, t) for dd, p, t in rows if dd == d and t is not None], 120, 30)
    with pytest.raises(ValueError):
        chunking.chunk_documents(spark.createDataFrame(rows, "doc string, page int, text string"), 10, 10)


def test_cuts_prefer_kind_over_place():
    text = "aaaa aaaa aaaa. bbbb bbbb? cccc cccc cccc"
    assert [t for _, _, t in chunking.chunk_pages([(1, text)], 40, 0)] == ["aaaa aaaa aaaa.", "bbbb bbbb? cccc cccc cccc"]
    assert [t for _, _, t in chunking.chunk_pages([(1, "x" * 50)], 40, 5)] == ["x" * 40, "x" * 15]
    assert list(chunking.chunk_pages([(1, ""), (2, ""), (3, "ab")], 2, 0)) == [(3, 0, "ab")]
    assert list(chunking.chunk_pages([(1, "abcd"), (2, ""), (3, "ef")], 4, 0)) == [(1, 0, "abcd"), (3, 1, "ef")]


def test_store_operations(spark):
    old = spark.createDataFrame([("a", 0, "old"), (None, 1, "n")], "doc string, ordinal int, text string")
    new = spark.createDataFrame([("a", 0, "new", 1), ("a", 1, "x", 2), ("a", 1, "y", 1), (None, 1, "m", 1), ("b", None, "z", 1), ("b", None, "zz", 2)], "doc string, ordinal int, text string, seq int")
    got = {tuple(r) for r in store.insert_ignore(old, new, ["doc", "ordinal"], [F.col("seq").asc()]).collect()}
    assert got == {("a", 0, "old"), (None, 1, "n"), ("a", 1, "y"), ("b", None, "z")}
    ids = store.surrogate_ids(spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "v int"), ["v"], start=10).orderBy("v").collect()
    assert [(r["v"], r["id"]) for r in ids] == [(i, i + 11) for i in range(50)]
    assert store.surrogate_ids(spark.createDataFrame([], "v int"), ["v"]).count() == 0
    src = spark.range(5)
    assert sorted(r["id"] for r in store.above_mark(src, spark.range(3)).collect()) == [3, 4]
    assert store.above_mark(spark.range(1, 5), spark.createDataFrame([], "id bigint")).count() == 4
    want = spark.createDataFrame([(0, 3), (1, 1), (2, 3), (3, 99)], "pos int, id bigint")
    assert sorted((r["pos"], r["id"]) for r in store.ordered_lookup(want, src).collect()) == [(0, 3), (1, 1), (2, 3)]
