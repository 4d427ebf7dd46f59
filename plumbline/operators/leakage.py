"""Filters that keep test material out of training material, and checks of question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import ascii_tokens, note_words
from plumbline.operators.dense import nearest_of_pool
from plumbline.operators.resample import draw
from plumbline.session import small_side


def _runs(tokens: Column, n: int) -> Column:
    """Each run of n tokens: a hash of its inner tokens, the first, the inner ones as text, the last. Shorter lists have none."""

    def cut(t: Column) -> Column:
        inner = lambda i: F.array_join(F.slice(t, i + 1, n - 2), " ")
        places = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.xxhash64(inner(i)).alias("h"), F.element_at(t, i).alias("first"), inner(i).alias("inner"), F.element_at(t, i + n - 1).alias("last")))

    # The token list is bound to a lambda variable, so that it is made once and not once per run.
    return F.flatten(F.transform(F.array(tokens), cut))


def verbatim_overlaps(probes: DataFrame, sources: DataFrame, n: int = 8) -> DataFrame:
    """(probe_id, shared): how many of a probe's distinct runs of n words stand in some source's text; probes with none are left out.

    Both sides are (id, text), reduced to words a-z0-9 with single blanks. A run is sought as text, so
    its first word may be the end, and its last word the beginning, of a longer word of the source.
    Texts of fewer than n words (n is 3 or more) have no runs. Null and empty texts share nothing.

    Runs meet on a hash of their inner words, which match whole; the ends are then compared as text.
    Where the probes' runs are few, they are broadcast, and of the sources only hits are shuffled.
    """
    run = F.inline(_runs(ascii_tokens(F.col("text")), n))
    a = probes.select(F.col("id").alias("probe_id"), run).distinct()
    wanted = a.select("h", F.col("first").alias("pf"), F.col("inner").alias("pi"), F.col("last").alias("pl")).distinct()
    wanted = small_side(wanted, wanted.count(), 128)
    hit = F.col("first").endswith(F.col("pf")) & (F.col("inner") == F.col("pi")) & F.col("last").startswith(F.col("pl"))
    found = sources.select(run).join(wanted, "h").where(hit).select(F.col("pf").alias("first"), F.col("pi").alias("inner"), F.col("pl").alias("last")).distinct()
    return a.join(found, ["first", "inner", "last"]).groupBy("probe_id").agg(F.count("*").alias("shared"))


def paraphrases(candidates: DataFrame, pool: DataFrame, least: float = 0.85) -> DataFrame:
    """(id, nearest): candidates (id, vec) with their highest cosine to the pool (vec), dropping those at or over ``least``.

    The pool is a stated set of test questions, met in blocks of bounded size; a candidate gives up
    one number a block. Null, all-zero and odd-sized vectors are near to nothing.
    """
    best = nearest_of_pool(candidates, pool)
    return best.where(F.col("nearest") < least)


def excluded_pages(gold: DataFrame, margin: int = 1) -> DataFrame:
    """(doc, page): every gold page of an answerable question and its neighbours."""
    near = F.explode(F.sequence(F.col("gold_page") - margin, F.col("gold_page") + margin))
    return gold.where("answerable and gold_page is not null and gold_doc is not null").select(F.col("gold_doc").alias("doc"), near.alias("page")).distinct()


def group_holdout(df: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """Adds ``split``: whole groups go to val, round(groups * share) of them, halves rounded to even."""
    groups = df.select(F.col(group).alias("g")).distinct()
    from pyspark.sql.window import Window

    bucket = F.substring(draw(seed, F.col("g")), 1, 2)
    keyed = groups.withColumn("d", draw(seed, F.col("g"))).withColumn("b", bucket)
    before = keyed.groupBy("b").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("b")) - F.col("c"))  # at most 256 rows
    total = F.broadcast(keyed.agg(F.count("*").alias("total")))
    ranked = keyed.join(F.broadcast(before), "b").crossJoin(total)
    pos = F.row_number().over(Window.partitionBy("b").orderBy("d", "g")) + F.col("before")
    val = ranked.withColumn("pos", pos).where(F.col("pos") <= F.bround(F.col("total") * share)).select("g")
    marked = df.join(val.withColumn("__v", F.lit(True)), df[group].eqNullSafe(val["g"]), "left").drop("g")
    return marked.withColumn("split", F.when(F.col("__v"), "val").otherwise("train")).drop("__v")


def ratio_cap(df: DataFrame, declines: str, share: float, seed: int, ident: str = "id") -> DataFrame:
    """All answers and the first round(answers * share / (1 - share)) declines of one fixed order, so that variants nest."""
    from pyspark.sql.window import Window

    answers = F.broadcast(df.agg(F.count(F.when(~F.col(declines), 1)).alias("__a")))  # one row
    numbered = df.where(F.col(declines)).withColumn("__d", draw(seed, F.col(ident)))
    numbered = numbered.withColumn("__b", F.substring("__d", 1, 2))
    before = numbered.groupBy("__b").agg(F.count("*").alias("c")).withColumn("__before", F.sum("c").over(Window.orderBy("__b")) - F.col("c")).drop("c")  # at most 256 rows
    pos = F.row_number().over(Window.partitionBy("__b").orderBy("__d", ident)) + F.col("__before")
    kept = numbered.join(F.broadcast(before), "__b").withColumn("__pos", pos).crossJoin(answers).where(F.col("__pos") <= F.bround(F.col("__a") * share / (1 - share)))
    return df.where(~F.col(declines)).unionByName(kept.select(*df.columns))


def note_support(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, problem, support): what is wrong with a question's citation; ``problem`` is 'ok' if nothing.

    A question that is not answerable must cite nothing; the manual must be known, the page have
    text, and half of the note's words stand in it (as substrings). Page and note are reduced to a-z,
    0-9 and blanks; a note without words to look for is sound, and its support null.
    """
    docs = pages.select("doc").distinct().withColumn("known", F.lit(True))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", " "), " +", " "))
    joined = questions.join(docs, questions["gold_doc"] == docs["doc"], "left").drop("doc")
    joined = joined.join(pages.select("doc", "page", plain.alias("ptext")), (F.col("gold_doc") == F.col("doc")) & (F.col("gold_page") == F.col("page")), "left")
    words = note_words(F.coalesce("note", F.lit("")))
    hit = F.size(F.filter(words, lambda w: F.col("ptext").contains(w)))
    has_text = F.coalesce(F.col("ptext"), F.lit("")) != ""
    support = F.when(has_text & F.coalesce("answerable", F.lit(False)) & F.col("known"), F.round(F.try_divide(hit.cast("double"), F.size(words)), 6))
    problem = (
        F.when(~F.coalesce("answerable", F.lit(False)), F.when(F.col("gold_doc").isNotNull() | F.col("gold_page").isNotNull(), "unanswerable cites a page").otherwise("ok"))
        .when(F.col("known").isNull(), "unknown manual")
        .when(~has_text, "page without text")
        .when(support < 0.5, "note not on page")
        .otherwise("ok")
    )
    return joined.select("id", problem.alias("problem"), support.alias("support"))


#: Bounds of the share of questions without answer.
UNANSWERABLE_SHARE = (0.25, 0.45)


def set_contract(questions: DataFrame) -> DataFrame:
    """(rule, rows): how many rows or keys break each rule of a question set; rules that hold are there with 0.

    Rows that are alike in all columns count once. Two questions are the same if they agree in
    lower case after all but a-z is turned into blanks and blanks are squeezed.
    """
    u = questions.select("id", "type", "question", "answerable", "gold_doc", "gold_page", "note", "source").distinct()
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    yes, no = F.coalesce("answerable", F.lit(False)), ~F.coalesce("answerable", F.lit(True))
    asked = F.trim(F.regexp_replace(F.regexp_replace(F.lower("question"), "[^a-z ]", " "), " +", " "))
    count = lambda c: F.count(F.when(c, 1))
    rules = u.agg(
        count(F.col("id").isNull() | F.col("type").isNull() | F.col("question").isNull() | F.col("answerable").isNull() | F.col("source").isNull()).alias("missing field"),
        count(F.col("question").isNotNull() & ~F.rtrim("question").endswith("?")).alias("question without mark"),
        count(yes & (blank(F.col("gold_doc")) | ~F.coalesce(F.col("gold_page") > 0, F.lit(False)) | blank(F.col("note")))).alias("answerable without source"),
        count(no & (F.col("gold_doc").isNotNull() | F.col("gold_page").isNotNull())).alias("unanswerable with source"),
        F.when(F.avg(F.when(no, 1.0).when(yes, 0.0)).between(*UNANSWERABLE_SHARE), 0).otherwise(1).cast("bigint").alias("share out of bounds"),
    )
    names = rules.columns
    broken = rules.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("rows")) for n in names])))
    again = lambda key, rule: u.where(key.isNotNull()).groupBy(key.alias("k")).count().where("count > 1").agg(F.count("*").alias("rows")).select(F.lit(rule).alias("rule"), "rows")
    return broken.unionByName(again(F.col("id"), "repeated id")).unionByName(again(asked, "repeated question"))
