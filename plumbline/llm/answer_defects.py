"""Problem 6: defective answers.

For each defect several noisy labelling functions vote yes, no or nothing on every answer; each looks
at something of its own, and none at another's vote. A label model per defect
(expectation-maximisation over the functions' accuracies) turns the votes into a posterior. The
cutoffs are validated on answers into which the defect was put: copies of all answers are cut off,
blanked, swapped for the question and so on, and the cutoff is taken that tells them best from the
answers as they are. Labels whose posterior reaches the cutoff are kept, several if need be. Only the counts
of vote patterns, at most 3 to the number of functions, reach the driver.
"""

from __future__ import annotations

import difflib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import cut_lineage, small_side

DEFECTS = ("empty", "refusal", "copies_question", "other_language", "truncated")  # in order of precedence
FUNCTIONS = {"empty": 3, "refusal": 6, "copies_question": 3, "other_language": 3, "truncated": 5}
SALTS = 16
#: Whether a function's silence is the other side of a one-sided vote. Those on languages are silent where a text shows none.
SILENCE = {d: d != "other_language" for d in DEFECTS}
LEAST_WORD = 3
LEAST_SHARE = 1e-6
YES, NO, NONE = 1, 0, -1

#: Frequent short words of each language.
STOPWORDS = {
    "en": "the a an and or of to in is are was be it on for with at from by that this which if when not must has have been than before after what how where why who does do can only as between its until no none there i you they he she we into out will would all any other".split(),
    "de": "der die das und oder ein eine einen einem des dem den ist sind war nicht mit auf für von zu zum zur im in bei nach vor wenn dass daß ob es sich wird werden muss an aus wie wann wo warum was welche welcher sie er ich wir hat haben sein über unter durch laut ohne keine".split(),
    "fr": "le la les l un une des du de d et ou est sont était il elle on ne pas se sa son ses ce cette que qui quand où comment pourquoi quel quelle dans sur pour avec par au aux en après avant donc faut doit sans si plus être à selon lorsque puis".split(),
    "es": "el la los las un una unos y o es son era no se su sus que de del en con por para al cuando dónde donde cómo como qué cuál antes después hay si lo más está debe sin sobre entre según le fue".split(),
}
#: Words that a finished sentence does not end with.
OPEN_END = frozenset(
    "the a an and or but nor of to in into onto on for with at from by that this these those which who whose if when whenever while where because so as than between until unless before after during through without within under over is are was were be been being has have had must will would shall should can could may might do does such its their his her your our not only both either neither each every per via about against is's "
    "der die das den dem des ein eine einen einem einer und oder aber mit auf für von zu zum zur im in bei nach vor wenn dass weil ob ist sind wird werden muss an aus wie durch ohne als bis sowie "
    "le la les un une des du de et ou mais dans sur pour avec par au aux en que qui dont donc est sont doit sans si car ne se "
    "el los las una unos unas y o pero del con por para al que cuando es son debe sin como porque su sus se".split()
)
_CITE = re.compile(r"\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]|\(\s*(?:source|quelle|fuente)\s*\d*\s*\)", re.I)
_LABEL = re.compile(r"^\s*(?:the\s+)?(?:answer|a|ans|response|reply|output|result|antwort|réponse|respuesta|question|q|frage|pregunta)\s*[:.\-–]\s*", re.I)
_HIDDEN = re.compile("[​-‏⁠﻿­]")
_ALNUM = re.compile(r"[^\W_]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: What stands in for an answer.
PLACEHOLDERS = frozenset("|na|n a|none|null|nil|nan|tbd|tba|todo|undefined|unknown|empty|blank|no answer|no response|not available|not applicable|keine|keine antwort|aucune|aucune réponse|ninguna|sin respuesta|answer|antwort|réponse|respuesta|a|source|sources|citation|placeholder|insert answer here|xxx".split("|"))

_REFUSE = re.compile(
    r"""insufficient|not\ (?:enough|sufficient)|(?:can\s?not|can't|could\ not|couldn't|unable\ to|not\ able\ to|impossible\ to|not\ possible\ to)\ (?:be\ )?(?:answer|tell|say|determin|help|find|provid|respond|give|assist|confirm|comment|see|verif|locate|state)
    |(?:cannot|can't)\ (?:\w+\ )?(?:be\ )?(?:answered|given|determined)|no\ answer|(?:not|n't)\ (?:know|contain|mention|cover|state|include|provide|specif|say|give|address|describe|list|appear|have\ (?:enough|that|this|the))|(?:is|are|was|were)\ not\ (?:stated|given|mentioned|covered|specified|included|provided|available|found|contained|described|listed)
    |never\ mention|rather\ not|decline|(?:must|have\ to)\ refuse|i\ (?:will|must|have\ to)\ (?:decline|refuse|abstain|pass)|none\ of\ the|nothing\ (?:in|about)|no\ (?:information|evidence|mention|data|relevant|passage|excerpt|source)|more\ (?:context|information|detail)|deal\ with\ another|only\ describe|unable\ to|^\W*(?:sorry|unfortunately|i'?m\ (?:sorry|afraid)|i\ apologi[sz]e|regrettably)\W*$|do(?:es)?\ not\ (?:know|contain)|don't\ know|not\ sure
    |kann\ (?:ich\ )?(?:\w+\ ){0,3}nicht\ (?:beantwort|sagen)|nicht\ (?:beantworten|enthalten|angegeben|genug)|keine\ (?:angabe|information|antwort)|weiß\ (?:ich\ )?nicht|leider\W*$|lässt\ sich\ nicht\ (?:sagen|beantworten)
    |ne\ (?:peux|sais|contien|mentionn|permet)\w*|impossible\ de\ (?:répondre|dire)|aucune\ (?:information|réponse|mention)|désolé
    |no\ (?:puedo|sé|contien|mencion|se\ (?:menciona|indica))\w*|imposible\ (?:responder|decir)|lo\ siento|ninguna\ (?:información|mención)""",
    re.I | re.X,
)
_META = re.compile(r"\b(?:excerpts?|passages?|sources?|contexts?|evidence|information|questions?|answers?|guess|assist(?:ant)?|help|(?:provided|retrieved|supplied|given|shown)\b.*\b(?:text|pages?|documents?)|(?:text|pages?|documents?)\b.*\b(?:provided|retrieved|supplied|given|shown)|sorry|respond|auszüge|extraits?|fragmentos?)\b", re.I)
_CLAUSE = re.compile(r"(?<=[.!?;:])\s+|;\s*|:\s+|,\s+(?=but\b|however\b|it\b|the\b|they\b|this\b|so\b|yet\b|although\b|aber\b|mais\b|pero\b)|\s+(?=but\b|however\b)")


def bare(answer: str) -> str:
    """The answer without hidden characters, citation marks and leading labels."""
    t = _CITE.sub(" ", _HIDDEN.sub("", answer))
    for _ in range(2):
        t = _LABEL.sub("", t)
    return " ".join(t.split())


def squeezed(text: str) -> str:
    return "".join(_ALNUM.findall(text.lower()))


@lru_cache(256)
def language(text: str) -> str | None:
    """By frequent words: the language with at least two hits more than any other, or with all hits of short texts."""
    words = Counter(re.findall(r"[^\W\d_]+", text.lower()))
    hits = sorted(((sum(words[w] for w in ws), name) for name, ws in STOPWORDS.items()), reverse=True)
    (best, name), (second, _) = hits[0], hits[1]
    return name if best >= 2 and best >= 1.5 * second else name if best and not second else None


@lru_cache(256)
def letters_language(text: str) -> str | None:
    """By letters and signs that only one of the languages uses."""
    t = text.lower()
    marks = {"de": len(re.findall("[äöüß]", t)), "es": len(re.findall("[ñ¿¡íóú]", t)), "fr": len(re.findall("[èêçàâîôûœëï]|\\b[ldjnsq]['’]", t))}
    best = max(marks, key=lambda k: marks[k])
    if marks[best] and sum(marks.values()) == marks[best]:
        return best
    return "en" if t.isascii() and len(t) > 60 and not any(marks.values()) and re.search(r"\bthe\b|\bof\b|\bis\b", t) else None


def clauses(text: str) -> list[str]:
    return [c for c in _CLAUSE.split(text) if c and _ALNUM.search(c)]


def refusal_votes(text: str, question: str | None, verdict: str | None, refused: bool | None) -> list[int]:
    """By clauses (all decline), by figures, by words that neither question nor talk about sources explains, by talk about sources or answering, by the prompt's flag, by the verdict."""
    parts = clauses(text)
    declines = [bool(_REFUSE.search(c)) for c in parts]
    beside = [bool(_META.search(c)) for c in parts]
    v_clause = YES if any(declines) and all(r or m for r, m in zip(declines, beside)) else NO
    v_figures = NO if re.search(r"\d", re.sub(r"\b[A-Z]{2}\d{3}[- ]?\d\b", "", text)) else NONE
    asked = set(_ALNUM.findall((question or "").lower()))
    new = {w for c in parts if not _REFUSE.search(c) and not _META.search(c) for w in _ALNUM.findall(c.lower()) if len(w) > 3 and w not in asked}
    v_new = NO if new else NONE
    v_prompt = YES if refused else NONE
    v_verdict = NO if re.sub(r"[^a-z]", "", (verdict or "").lower()) == "correct" else NONE
    v_meta = YES if any(beside) else NO
    return [v_clause, v_figures, v_new, v_meta, v_prompt, v_verdict]


def copy_votes(text: str, question: str | None) -> list[int]:
    """By equal letters and figures (once or several times over), by words not in the question, by the similarity of texts of like length."""
    q, a = squeezed(question or ""), squeezed(re.sub(r"^\W*(?:you asked|the question (?:is|was))\W*", "", text, flags=re.I))
    if not q or not a:
        return [NO, NO, NO]
    qw, aw = set(_ALNUM.findall((question or "").lower())), _ALNUM.findall(text.lower())
    v_words = YES if all(w in qw for w in aw) and len(set(aw)) >= 0.8 * len(qw) else NO
    alike = difflib.SequenceMatcher(None, a, q, autojunk=False)
    v_close = (NONE if len(a) > len(q) else NO) if not 0.8 * len(q) <= len(a) <= 1.25 * len(q) else YES if a == q or alike.quick_ratio() >= 0.93 and alike.ratio() >= 0.93 else NO
    return [YES if a == q * max(1, round(len(a) / len(q))) else NO, v_words, v_close]


def empty_votes(answer: str | None, text: str) -> list[int]:
    """By words that stand in for an answer, by letters or figures beside citation marks, by length."""
    words = " ".join(_ALNUM.findall(text.lower()))
    said = "" if answer is None else _CITE.sub("", _HIDDEN.sub("", answer))
    return [YES if words in PLACEHOLDERS else NO, NONE if _ALNUM.search(said) else YES, YES if not _ALNUM.search(text) else NO if len(words) > 24 else NONE]


#: Endings of English words, and such as end words of the other languages only.
ENGLISH_ENDINGS = ("ing", "ed", "ly", "th", "ck", "ow", "wn")
OTHER_ENDINGS = ("ung", "ieren", "lich", "keit", "gen", "eur", "eux", "ée", "ez", "ère", "ción", "ado", "ada", "dora", "os", "as", "ezca", "iene")


@lru_cache(256)
def ending_language(text: str) -> str | None:
    """By word endings: English or other, whichever has at least twice as many hits. They do not tell the others apart."""
    words = [w for w in re.findall(r"[^\W\d_]+", text.lower()) if len(w) > 3]
    en, other = (sum(w.endswith(ends) for w in words) for ends in (ENGLISH_ENDINGS, OTHER_ENDINGS))
    return "en" if en >= 2 and en >= 2 * other else "other" if other >= 2 and other >= 2 * en else None


def fits_any_language(text: str) -> bool:
    return len(re.findall(r"[^\W\d_]{4,}", text)) < 3


def language_votes(text: str, question: str | None) -> list[int]:
    """By frequent words, by letters that one language alone has, by word endings, each comparing answer and question.

    Where a function knows no language of an answer of less than three longer words, it takes it for
    one that fits any language (a measure, a number of a part).
    """
    if not question:
        return [NONE, NONE, NONE]
    few = fits_any_language(text)
    differ = lambda m, n: (NO if few else NONE) if m is None else NONE if n is None else YES if m != n else NO
    return [differ(f(text), f(question)) for f in (language, letters_language, ending_language)]


def end_tokens(text: str) -> list[tuple[str, str]]:
    """(token with figures masked, what follows it: '.' sentence end, '' nothing, ' ' more, ',' a comma)."""
    out = []
    for t in text.split():
        m = re.match(r"^[\W_]*(.*?)([.!?;:,…]*)[\W_]*$", t)
        core = re.sub(r"\d+", "#", re.sub(r"^\d+[.,]\d+$", "#", m[1].lower())) if m else ""
        if core:
            out.append((core, "." if re.search(r"[.!?…;:]", t[-3:]) else "," if t.endswith(",") else " "))
    if out and out[-1][1] == " ":
        out[-1] = (out[-1][0], "")
    return out


def truncation_votes(text: str, p_end: float | None, run: int | None, known: bool | None) -> list[int]:
    """By the last sign, by a word or sign no sentence ends with, by a last token that is broken off a word, by how such endings go on elsewhere, by brackets left open."""
    tokens = end_tokens(text)
    if not tokens:
        return [NO, NONE, NONE, NONE, NONE]
    closed = bool(re.search(r"[.!?…][\"'”’»)\]]*\s*$", text))
    phrase = len(tokens) <= 4 and tokens[-1][0] not in OPEN_END  # needs no closing sign
    v_sign = NO if closed or phrase else NONE
    v_word = YES if tokens[-1][0] in OPEN_END and not closed or text.rstrip().endswith((",", ";", ":", "-", "(", "–", "‐")) else NONE
    v_broken = NONE if known is None else NO if known else YES
    enough = (run or 0) >= (2 if len(tokens) > 4 else 3)  # a shorter run says too little
    v_goes_on = NONE if p_end is None or not enough else NO if p_end > 0.5 else YES if p_end < 0.2 else NONE
    v_bracket = YES if any(text.count(a) > text.count(b) for a, b in ("()", "[]", "“”", "«»")) else NONE
    return [v_sign, v_word, v_broken, v_goes_on, v_bracket]


# ---- label model ----------------------------------------------------------------------------


class LabelModel:
    """Posterior of a defect for any vote pattern.

    Each function has its own chances of yes, no and silence on defective and on sound answers,
    smoothed towards a function that speaks in seven of ten cases and is then right four times in five.
    They are estimated by expectation-maximisation from the counts of vote patterns; the start is
    the majority, a tie being open. Without ``silence`` only what functions say counts.
    """

    EXPECTED = ({YES: 0.56, NO: 0.14, NONE: 0.3}, {YES: 0.14, NO: 0.56, NONE: 0.3})  # on defective and on sound answers
    WEIGHT = 8.0  # answers that the expectation is worth

    def __init__(self, patterns: dict[tuple[int, ...], int], silence: bool = True, rounds: int = 60):
        votes = np.array(list(patterns), dtype=np.int64)
        n = np.array(list(patterns.values()), dtype=np.float64)
        balance = (votes == YES).sum(axis=1) - (votes == NO).sum(axis=1)
        post = np.where(balance > 0, 0.95, np.where((balance == 0) & (votes == YES).any(axis=1), 0.5, 0.001))
        for _ in range(rounds):
            share = float(np.clip((post @ n + 0.5) / (n.sum() + 1), 1e-4, 0.6))
            self.log_prior = float(np.log(share / (1 - share)))
            self.log_odds = []
            for j in range(votes.shape[1]):
                chance = lambda v, weights, expected: (weights[votes[:, j] == v].sum() + self.WEIGHT * expected[v]) / (weights.sum() + self.WEIGHT)  # noqa: B023, E731
                if not silence:
                    spoken = votes[:, j] != NONE
                    chance = lambda v, weights, expected: (weights[votes[:, j] == v].sum() + self.WEIGHT * expected[v]) / (weights[spoken].sum() + self.WEIGHT * (expected[YES] + expected[NO])) if v != NONE else 1.0  # noqa: B023, E731
                self.log_odds.append({v: float(np.log(chance(v, post * n, self.EXPECTED[0])) - np.log(chance(v, (1 - post) * n, self.EXPECTED[1]))) for v in (YES, NO, NONE)})
            new = np.array([self.posterior(tuple(p)) for p in votes])
            if np.abs(new - post).max() < 1e-6:
                break
            post = new

    def posterior(self, pattern: tuple[int, ...]) -> float:
        odds = self.log_prior + sum(o[int(v)] for o, v in zip(self.log_odds, pattern))
        return float(1 / (1 + np.exp(-np.clip(odds, -50, 50))))


def majority(pattern: tuple[int, ...]) -> bool:
    return sum(v == YES for v in pattern) > sum(v == NO for v in pattern)


def best_cutoff(planted: list[float], others: list[float], times: tuple[list[int], list[int]] | None = None) -> float:
    """The posterior that tells planted defects best from other answers (by F1); the middle of the best span. Without planted ones one half.

    ``times`` says how many answers each of the planted and of the other posteriors stands for, else one.
    """
    if not planted or not others:
        return 0.5
    values = np.unique([*planted, *others, 0.0, 1.0])
    cuts = (values[1:] + values[:-1]) / 2
    a, b = np.array(planted), np.array(others)
    of_a, of_b = map(np.array, times or ([1] * len(a), [1] * len(b)))
    f1 = np.array([2 * (hit := of_a[a >= c].sum()) / max(1, hit + of_a.sum() + of_b[b >= c].sum()) for c in cuts])
    best = cuts[f1 >= f1.max() - 1e-9]
    return float(np.clip((best.min() + best.max()) / 2, 0.05, 0.95))


def _endings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Over all answers: (gram, ends, goes_on, stops) of runs of 1 to 4 tokens, and those that answers, whole or cut off, end with, with what they are counted as there."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stats: dict[str, list[int]] = {}

        def out() -> pd.DataFrame:
            df = pd.DataFrame([(g, *v) for g, v in stats.items()], columns=["gram", "ends", "goes_on", "stops"])
            stats.clear()
            return df

        for batch in batches:
            for text in batch["bare"]:
                tokens = end_tokens(text)
                for i, (_, sign) in enumerate(tokens):
                    k = 0 if sign == "." else 2 if sign == "" else 1
                    for size in range(1, 5):
                        if i + 1 >= size:
                            g = " ".join(t for t, _ in tokens[i + 1 - size : i + 1])
                            stats.setdefault(g, [0, 0, 0])[k] += 1
            if len(stats) > 400_000:
                yield out()
        yield out()

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for key, text in zip(batch["id"], batch["bare"]):
                tokens = end_tokens(text)
                for name, end in ((key, tokens), (planted_id("truncated", key), end_tokens(cut_off(text, key)))):
                    runs = []
                    for size in range(1, min(4, len(end)) + 1):
                        run, there = [t for t, _ in end[-size:]], tokens[len(end) - size : len(end)]
                        counted = -1 if run != [t for t, _ in there] else 0 if there[-1][1] == "." else 2 if there[-1][1] == "" else 1
                        runs.append({"size": size, "gram": " ".join(run), "counted": counted})
                    got.append((name, runs))
            yield pd.DataFrame(got, columns=["id", "runs"])

    texts = rows.where("bare is not null and bare <> ''").select("id", "bare")
    grams = texts.select("bare").mapInPandas(count, "gram string, ends bigint, goes_on bigint, stops bigint")
    grams = grams.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("ends", "goes_on", "stops")])
    ends = cut_lineage(texts.mapInPandas(last, "id string, runs array<struct<size: int, gram: string, counted: int>>"))
    return grams, ends.select("id", F.inline("runs"))


def _end_evidence(rows: DataFrame) -> DataFrame:
    """(id, p_end, run, known) of the answers and of those cut off: how often elsewhere a sentence ends after the last tokens, by
    the longest run seen three times, and its length; and whether the last token is a word that stands elsewhere (true) or one broken off (false)."""
    grams, last = _endings(rows)
    # Of the counted runs only those at some answer's end matter; a run of many answers is asked for once.
    asked = last.select("gram").distinct().withColumn("asked", F.lit(True))
    kept = cut_lineage(grams.join(asked, "gram", "left").where("asked or not gram like '% %'"))
    stats = kept.where("asked").drop("asked")
    n = stats.count()
    salted = stats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    last = last.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    met = last.join(small_side(salted, n * SALTS, 96), ["gram", "salt"])
    for i, c in enumerate(("ends", "goes_on", "stops")):  # without the answer itself
        met = met.withColumn(c, F.col(c) - F.when(F.col("counted") == i, 1).otherwise(0))
    total = F.col("ends") + F.col("goes_on") + F.col("stops")
    rate = F.when(total >= 3, F.struct(F.col("size"), ((F.col("ends") + F.col("stops")) / total).alias("rate")))
    known = F.max(F.when((F.col("size") == 1) & (F.col("gram") != "#"), F.col("ends") + F.col("goes_on") >= LEAST_WORD))
    seen = F.max(F.when((F.col("size") == 1) & (F.col("gram") != "#"), F.lit(True)))
    best = met.groupBy("id").agg(F.max(rate).alias("best"), known.alias("known"), seen.alias("seen"))
    ends = last.where("size = 1 and gram <> '#'").select("id").distinct().join(best, "id", "left")
    # A token that stands nowhere else is a broken word if a word of several places begins with it.
    words = kept.where(~F.col("gram").contains(" ") & (F.col("ends") + F.col("goes_on") + F.col("stops") >= LEAST_WORD)).select("gram")
    begun = words.where("length(gram) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("gram") - 1), lambda i: F.substring(F.col("gram"), F.lit(1), i))).alias("gram"))
    unknown = last.where("size = 1").select("id", "gram").join(ends.where("not coalesce(known, false)").select("id"), "id", "left_semi")
    broken = unknown.join(begun.distinct(), "gram", "left_semi").select("id", F.lit(True).alias("broken"))
    ends = ends.join(broken, "id", "left").select("id", "best", F.when(F.col("known"), True).when(F.col("broken"), False).alias("known"))
    figures = best.where("seen is null").select("id", "best", F.lit(None).cast("boolean").alias("known")).join(ends.select("id"), "id", "left_anti")
    return ends.unionByName(figures).select("id", F.col("best.rate").alias("p_end"), F.col("best.size").alias("run"), "known")


def answers_with_questions(scores: DataFrame, golden: DataFrame) -> DataFrame:
    """One row per distinct id: its answer (of several the least, null last), verdict, flag and question."""
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.col("answer").asc_nulls_last(), "verdict", "refused_by_prompt"))
    rows = scores.where("id is not null").select("id", "answer", "verdict", "refused_by_prompt").distinct().withColumn("n", first).where("n = 1").drop("n")
    asked = golden.where("id is not null").groupBy("id").agg(F.min("question").alias("question"))
    to_bare = F.udf(lambda a: None if a is None else bare(a), "string", useArrow=True)
    return rows.join(asked, "id", "left").withColumn("bare", to_bare("answer"))


PLANT = "\0"  # begins the ids of answers with a planted defect
#: Refusals that are planted.
REFUSALS = ("Insufficient evidence.", "The excerpts do not say.", "I cannot answer this from the given pages.", "Leider kann ich das nicht beantworten.", "No information about this is given in the sources.")


def planted_id(kind: str, key: str) -> str:
    return f"{PLANT}{kind}{PLANT}{key}"


def cut_off(text: str, key: str) -> str:
    """The answer broken off somewhere between its first and its last quarter."""
    return bare(text[: len(text) // 4 + zlib.crc32(key.encode()) % max(1, len(text) // 2)].rstrip(" .!?"))


def planted_votes(key: str, text: str, question: str | None, p_end: float | None, run: int | None, known: bool | None) -> dict[str, list[int]]:
    """By defect, the votes on the answer's copy into which it is put; what cannot be put into it is left out."""
    n, cut = zlib.crc32(key.encode()), cut_off(text, key)
    empty = ("", "[1]", "N/A", "Answer:")[n % 4]
    out = {"empty": empty_votes(empty, bare(empty)), "refusal": refusal_votes(bare(REFUSALS[n % len(REFUSALS)]), question, None, None)}
    if question and squeezed(question):
        asked = language(question)
        if asked and not fits_any_language(text):  # the answer itself, under a question in a language that is neither its own nor its question's
            others = [x for name, x in QUESTION_SAMPLES.items() if name not in (asked, language(text))]
            foreign = language_votes(text, others[n % len(others)])
        else:
            foreign = language_votes(LANGUAGE_SAMPLES["de" if asked == "en" else "en"], question)
        out |= {"copies_question": copy_votes(bare(question if n % 2 else question.upper()), question), "other_language": foreign}
    if cut:
        out["truncated"] = truncation_votes(cut, p_end, run, known)
    return out


#: A question in each language, under which answers in another are planted.
QUESTION_SAMPLES = {
    "de": "Wie wird die Dichtung nach der Prüfung des Getriebes gereinigt, und welche Werkzeuge werden dafür benötigt?",
    "fr": "Comment le joint de la pompe doit-il être nettoyé après le contrôle, et où le mécanicien est-il placé ?",
    "es": "¿Cómo se debe limpiar la junta de la bomba después de la revisión y dónde está indicado?",
    "en": "How is the gasket of the gearbox cleaned after the inspection, and which tools are needed for removing it?",
}
#: Planted under questions in another language where the answer itself fits any language.
LANGUAGE_SAMPLES = {
    "de": "Der Filter wird nach der Prüfung ausgebaut, gereinigt und mit einer neuen Dichtung wieder eingesetzt.",
    "en": "The filter is removed after the inspection, cleaned and installed again with a new gasket in the housing.",
}


def judged(scores: DataFrame, golden: DataFrame) -> DataFrame:
    """(id, one array of votes per defect on the answer, and in put_ on its copy into which the defect is put, null where it cannot be)."""
    rows = cut_lineage(answers_with_questions(scores, golden))
    found, is_cut, ours = F.struct("p_end", "run", "known"), F.col("id").startswith(PLANT), len(planted_id("truncated", ""))
    evidence = _end_evidence(rows).groupBy(F.when(is_cut, F.substring("id", ours + 1, 1 << 30)).otherwise(F.col("id")).alias("id"))
    evidence = evidence.agg(F.max(F.when(~is_cut, found)).alias("whole"), F.max(F.when(is_cut, found)).alias("cut"))
    joined = rows.join(evidence, "id", "left").select("id", "answer", "verdict", "refused_by_prompt", "question", "bare", *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("whole", "cut") for c in ("p_end", "run", "known")])
    columns = [*DEFECTS, *[f"put_{d}" for d in DEFECTS]]

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = lambda x: None if x is None or x is pd.NA or x != x else x
        for b in batches:
            out = []
            for row in zip(*(b[c] for c in b.columns)):
                key, answer, verdict, refused, question, text, p_end, run, known, *cut = map(none, row)
                text = "" if answer is None else text
                if answer is None or not re.search(r"\]\s*\W?$", answer):
                    ending = text if answer is None else _CITE.sub(" ", _HIDDEN.sub("", answer)).strip()
                else:  # a citation mark closes an answer
                    ending = text + "."
                put = planted_votes(key, text, question, *cut)
                out.append((key, empty_votes(answer, text), refusal_votes(text, question, verdict, refused), copy_votes(text, question), language_votes(text, question), truncation_votes(ending, p_end, run, known), *(put.get(d) for d in DEFECTS)))
            yield pd.DataFrame(out, columns=["id", *columns])

    return joined.mapInPandas(vote, "id string, " + ", ".join(f"{c} array<int>" for c in columns))


def by_kind(voted: DataFrame) -> DataFrame:
    """(id, kind, defect, votes) of the ``judged``: of each answer (kind null), of its copy with the defect put in (kind the
    defect) and of the answer as it is, "sound", without verdict and flag, which planted ones do not have either."""
    unseen = F.concat(F.slice("refusal", 1, 4), F.array(F.lit(NONE), F.lit(NONE)))
    one = lambda kind, d, v: F.struct(kind.cast("string").alias("kind"), F.lit(d).alias("defect"), v.alias("votes"))
    each = [x for d in DEFECTS for x in (one(F.lit(None), d, F.col(d)), one(F.lit(d), d, F.col(f"put_{d}")), one(F.lit("sound"), d, unseen if d == "refusal" else F.col(d)))]
    return voted.select("id", F.inline(F.array(*each))).where("votes is not null")


def votes(scores: DataFrame, golden: DataFrame) -> DataFrame:
    """(id, one array of votes per defect), with the answers that have planted defects."""
    named = F.when(F.col("kind").isNull(), F.col("id")).otherwise(F.concat(F.lit(PLANT), "kind", F.lit(PLANT), "id"))
    return by_kind(judged(scores, golden)).groupBy(named.alias("id")).agg(*[F.first(F.when(F.col("defect") == d, F.col("votes")), True).alias(d) for d in DEFECTS])


def posteriors(scores: DataFrame, golden: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """((id, one posterior per defect) of every distinct id, the validated cutoff of each defect)."""
    out, cutoffs = cut_lineage(judged(scores, golden)), {}
    counts = by_kind(out).groupBy("kind", "defect", "votes").agg(F.count("*").alias("n")).collect()  # at most 3 * 3 ** FUNCTIONS[d] for each
    for d in DEFECTS:
        of = lambda k: {tuple(r["votes"]): r["n"] for r in counts if r["defect"] == d and r["kind"] == k}  # noqa: B023, E731
        if not (real := of(None)):
            return out.select("id", *[F.lit(0.0).alias(x) for x in DEFECTS]), dict.fromkeys(DEFECTS, 0.5)
        model, put, sound = LabelModel(real, SILENCE[d]), of(d), of("sound")
        cutoffs[d] = best_cutoff([model.posterior(v) for v in put], [model.posterior(v) for v in sound], ([*put.values()], [*sound.values()]))
        known = out.sparkSession.createDataFrame([(list(k), model.posterior(k)) for k in real], f"`{d}` array<int>, `{d}_p` double")
        out = out.join(F.broadcast(known), d)
    return out.select("id", *[F.col(f"{d}_p").alias(d) for d in DEFECTS]), cutoffs


def all_labels(scores: DataFrame, golden: DataFrame) -> DataFrame:
    """(id, defect, posterior): every label whose posterior reaches its cutoff; an id may have several."""
    p, cutoffs = posteriors(scores, golden)
    each = F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("posterior"), F.lit(cutoffs[d]).alias("cutoff")) for d in DEFECTS])
    return p.select("id", F.inline(each)).where("posterior >= cutoff").select("id", "defect", F.round("posterior", 6).alias("posterior"))


def first_defect(scores: DataFrame, golden: DataFrame) -> DataFrame:
    """p6_found: (id, defect), the first label that holds for each defective id.

    Null ids are dropped; rows repeated under one id count once; answers without a question are
    not judged for copying or language; null verdicts and flags say nothing.
    """
    p, cutoffs = posteriors(scores, golden)
    pick = F.coalesce(*[F.when(F.col(d) >= cutoffs[d], F.lit(d)) for d in DEFECTS])
    return p.select("id", pick.alias("defect")).where("defect is not null")
