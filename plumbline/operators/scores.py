"""Scores of an answer's trustworthiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import REFUSAL, citations_valid, content_words, is_refusal

#: Spellings of the two replies whose probability is read.
YES = ("YES", "Yes", "yes", " YES", " Yes", " yes")
NO = ("NO", "No", "no", " NO", " No", " no")


def agreement(samples: DataFrame, key: str, sample_no: str, text: str) -> DataFrame:
    """(key, agreement): mean Jaccard of the content words of all pairs of a key's samples.

    Samples without content words drop out; fewer than two leave 0. A key's samples are few
    (draws of one answer); pairs are formed within the row of the key.
    """
    words = content_words(F.coalesce(F.col(text), F.lit("")))
    kept = F.filter(F.array_sort(F.collect_list(F.struct(F.col(sample_no).alias("n"), words.alias("w")))), lambda x: F.size(x["w"]) > 0)
    per = samples.groupBy(key).agg(kept.alias("s"))
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda b: F.size(F.array_intersect(a["w"], b["w"])) / F.size(F.array_union(a["w"], b["w"])))))
    mean = F.aggregate(pairs, F.lit(0.0), lambda t, x: t + x, lambda t: F.try_divide(t, F.size(pairs)))
    return per.select(key, F.coalesce(F.round(mean, 6), F.lit(0.0)).alias("agreement"))


def agreement_without_refusals(samples: DataFrame, key: str, sample_no: str, text: str) -> DataFrame:
    """As ``agreement``, but 0 if any sample is blank or a refusal."""
    bad = samples.groupBy(key).agg(F.max(is_refusal(F.col(text)) | (F.coalesce(F.trim(text), F.lit("")) == "")).alias("bad"))
    both = agreement(samples, key, sample_no, text).join(bad, key)
    return both.select(key, F.when(F.col("bad"), 0.0).otherwise(F.col("agreement")).alias("agreement"))


def mass(dist: Column, tokens: tuple[str, ...]) -> Column:
    """Probability of the given tokens in a map token -> probability."""
    wanted = F.array(*[F.lit(t) for t in tokens])
    return F.aggregate(F.map_values(F.map_filter(dist, lambda t, _: F.array_contains(wanted, t))), F.lit(0.0), lambda s, p: s + p)


def yes_probability(dist: Column) -> Column:
    """P(yes) among yes and no; 0 if neither is there."""
    yes, no = mass(dist, YES), mass(dist, NO)
    return F.coalesce(F.try_divide(yes, yes + no), F.lit(0.0))


def decline_mass(dist: Column) -> Column:
    """Probability that the reply starts to spell the refusal: at least two characters, case as written."""
    word = F.lit(REFUSAL.split()[0])
    starts = F.map_filter(dist, lambda t, _: (F.length(F.trim(t)) >= 2) & word.startswith(F.trim(t)))
    return F.aggregate(F.map_values(starts), F.lit(0.0), lambda s, p: s + p)


def head_score(signals: list[Column], answer: Column, n_excerpts: Column, veto: bool = True) -> Column:
    """The least signal, each held to 0-1; 0 without signals, and with ``veto`` for refusals and citations of excerpts not given."""
    if not signals:
        return F.lit(0.0)
    least = F.array_min(F.array(*[F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)) for s in signals]))
    if not veto:
        return least
    bad = is_refusal(answer) | ((n_excerpts > 0) & ~citations_valid(answer, n_excerpts))
    return F.when(F.coalesce(answer, F.lit("")) != "", F.when(bad, 0.0).otherwise(least)).otherwise(least)


def combined_score(groundedness: Column, consistency: Column) -> Column:
    return F.sqrt(F.greatest(groundedness, F.lit(0.0)) * F.greatest(consistency, F.lit(0.0)))


def combination_rules(su: Column, v2: Column, gr: Column, sc: Column, refused: Column) -> dict[str, Column]:
    """Ways to make one score of four signals: each alone, means, conjunctions, conjunctions with veto."""
    veto = lambda c: F.when(F.coalesce(refused, F.lit(False)), 0.0).otherwise(c)
    return {
        "support_v1": su, "support_v2": v2, "groundedness": gr, "self_consistency": sc,
        "geo(gr,sc)": F.sqrt(gr * sc), "mean(su,gr)": (su + gr) / 2,
        "min(su,gr)": F.least(su, gr), "min(su,sc)": F.least(su, sc), "min(gr,sc)": F.least(gr, sc),
        "min(su,gr,sc)": F.least(su, gr, sc), "min(su,gr,v2)": F.least(su, gr, v2),
        "min(su,gr)+veto": veto(F.least(su, gr)), "su+veto": veto(su),
    }
