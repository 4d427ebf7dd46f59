"""Problem 9: abusive, hateful and sexual content, by compression distance.

Texts are cut into windows (sentences; long ones in overlapping parts) and normalised against
disguises (figures and signs for letters, letters set apart, drawn-out letters, other scripts'
look-alikes). Two zstandard dictionaries are trained, one on toxic and one on ordinary windows; a
window is scored by how much shorter the toxic dictionary packs it than the ordinary one. The
threshold is calibrated on held-out folds of the labelled documents.

Raters label documents, not sentences, and err. Training therefore goes in rounds: at first all
windows of documents labelled 1 count as toxic, afterwards only those that the dictionaries of
the other folds packed clearly better as toxic. A window of the same wording under both labels goes
to the side where it stands far more often, so that single wrong labels do not enter a dictionary.
There is no word list.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage, spread

LABELLED = 20_000  # at most so many labelled documents fit the classifier, by hash order; scoring reads all
DICT_BYTES = 110_000
WINDOW = 160
STEP = 110
LEVEL = 6
SHORT = 40  # packed lengths below this count as this much, as a few bytes decide there
FOLDS = 4
LEAN = 3  # a wording is toxic material if its share of label-1 documents is so many times that of label-0 ones
RARE = 0.005  # a wording of more label-0 documents than this share is ordinary for certain
MARGINS = (0.15, 0.1, 0.05)  # least distance of a toxic window, from round to round

#: Signs standing for letters, and look-alikes of other scripts.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "8": "b", "9": "g", "+": "t"})
LOOKALIKES = str.maketrans("аеорсухікмтвнАЕОРСУХІКМТВН" + "αορεικντυ", "aeopcyxikmtbnaeopcyxikmtbn" + "aopeikvtu")
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿️]")
_APART = re.compile(r"(?<![^\s\"'(])(?:[^\W_]|[@$!|*])(?:([ .\-_*~·])(?:[^\W_]|[@$!|*])){2,}(?![^\W_])(?:\1(?=\s|$))?")
_MIXED = re.compile(r"[^\W_]*(?:[a-zß-ÿ][0-9@$|!+€]|[0-9@$|€][a-zß-ÿ])[\w@$|!+€]*")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_NUMBER = re.compile(r"\d[\d.,/\-]*")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|\s*[\r\n]+\s*")
_SPACE = re.compile(r"\s+")
_OTHER = re.compile(r"[^\w#' -]+")


def _leet(m: re.Match) -> str:
    w = m[0]
    letters = sum(ch.isalpha() for ch in w)
    if w[-1] == "!":
        return _MIXED.sub(_leet, w.rstrip("!")) + w[len(w.rstrip("!")) :]
    return w.translate(LEET) if letters >= 2 and letters * 2 >= len(w) - 1 and not re.fullmatch(r"[a-z]{1,2}\d+|\d+[a-z]{1,2}(?:\d+)?", w) else w


def normalise(text: str) -> str:
    """Lower case, without disguises, accents and figures."""
    t = text if text.isascii() else _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).translate(LOOKALIKES)
    t = _APART.sub(lambda m: re.sub(r"[ .\-_*~·]", "", m[0]), t).lower()
    t = _MIXED.sub(_leet, t)
    t = _LONG.sub(r"\1", t)
    if not t.isascii():
        t = "".join(ch for ch in unicodedata.normalize("NFD", t.replace("ß", "ss")) if not unicodedata.combining(ch))
    t = _OTHER.sub(" ", _NUMBER.sub("#", t))
    return _SPACE.sub(" ", t).strip()


def windows(text: str | None) -> list[str]:
    """Normalised windows that cover the whole text; none for null and blank texts."""
    out = []
    for s in _SENTENCE.split(text or ""):
        if not s or s.isspace():
            continue
        n = normalise(s)
        if len(n) <= WINDOW + STEP // 2:
            out += [n] if len(n) > 2 else []
            continue
        lo = 0
        while True:
            hi = min(len(n), lo + WINDOW)
            end = n.rfind(" ", lo + STEP, hi) if hi < len(n) else hi
            end = hi if end <= lo else end
            out.append(n[lo:end])
            if hi >= len(n):
                break
            at = n.find(" ", lo + STEP, hi)
            lo = (at + 1) if at > lo else lo + STEP
    return out


# ---- dictionaries ---------------------------------------------------------------------------


def train_dictionary(samples: list[str]) -> bytes:
    """A zstandard dictionary trained on the samples; those the trainer refuses for being too few are the dictionary themselves."""
    parts = [w.encode() for w in samples]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts, k=64, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(parts) or b"........"


class Packer:
    """Packed lengths of windows under one dictionary."""

    def __init__(self, dictionary: bytes):
        data = zstandard.ZstdCompressionDict(dictionary)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=20, min_match=3, strategy=zstandard.STRATEGY_BTOPT, search_log=6, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
        data.precompute_compress(compression_params=params)
        self.packer = zstandard.ZstdCompressor(dict_data=data, compression_params=params)

    def length(self, window: str) -> int:
        return len(self.packer.compress(window.encode()))


class Model:
    """A toxic and an ordinary dictionary, and the distance from which a document is flagged."""

    def __init__(self, toxic: bytes, ordinary: bytes, threshold: float = 0.0):
        self.toxic, self.ordinary, self.threshold = Packer(toxic), Packer(ordinary), threshold
        self.memo: dict[str, float] = {}

    def distance(self, window: str) -> float:
        """Share of the window that the toxic dictionary saves against the ordinary one, in -1 to 1."""
        if (known := self.memo.get(window)) is not None:
            return known
        o, t = self.ordinary.length(window), self.toxic.length(window)
        score = (o - t) / max(o, t, SHORT)
        if len(self.memo) >= 300_000:
            self.memo.clear()
        self.memo[window] = score
        return score

    def score(self, text: str | None) -> float:
        """The highest distance of the text's windows; -1 for null and blank texts."""
        return max((self.distance(w) for w in windows(text)), default=-1.0)


def _mixed(samples: list[str]) -> list[str]:
    """In an order set by their text alone, with equal ones apart: the trainer takes a share from each stretch of its samples."""
    nth = Counter()
    keyed = []
    for w in samples:
        nth[w] += 1
        keyed.append((zlib.crc32(f"{nth[w]} {w}".encode()), w))
    return [w for _, w in sorted(keyed)]


Labelled = tuple[int, list[str], "list[float] | None"]  # label, windows, their distances so far


def train(docs: list[Labelled], margin: float | None) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionaries of labelled documents.

    Toxic samples are the windows of documents labelled 1 over the margin (all of them in the first
    round, and where none is over it); ordinary ones are the windows of documents labelled 0. A wording is a sample as often as
    documents have it, so that what all texts have is sure to enter; a rare one that held-out
    dictionaries packed as toxic is left out, as its document may be labelled wrongly.
    """
    ones = sum(y for y, _, _ in docs)
    share = {1: Counter(), 0: Counter()}
    for y, ws, _ in docs:
        share[y].update(set(ws))
    n = {1: max(1, ones), 0: max(1, len(docs) - ones)}
    leans = lambda w: share[1][w] / n[1] >= LEAN * share[0][w] / n[0]
    every = [(w, margin is None or d[j] > margin) for y, ws, d in docs if y for j, w in enumerate(ws) if leans(w)]
    toxic = [w for w, over in every if over] or [w for w, _ in every]
    doubted = set() if margin is None else {w for y, ws, d in docs if not y for j, w in enumerate(ws) if d[j] > MARGINS[0] and share[0][w] <= RARE * n[0]}
    ordinary = [w for w, c in share[0].items() if not leans(w) and w not in doubted for _ in range(c)]
    return train_dictionary(_mixed(toxic)), train_dictionary(_mixed(ordinary))


def calibrate(scores: list[float], labels: list[int]) -> float:
    """The cut at which held-out documents agree best with their labels.

    Wrong labels at equal rates leave the best cut where it is. Of all cuts within a thousandth of
    the best agreement the one at a quarter of their span is taken, as ordinary windows end more sharply
    than toxic ones begin. Where held-out documents are told best by flagging none, too few phrases come
    twice to be calibrated on, and the first margin is the cut. Without documents of both labels
    nothing can be told, and nothing is flagged.
    """
    if len(set(labels)) < 2:
        return 1.0
    s, y = np.array(scores), np.array(labels)
    order = np.argsort(s, kind="stable")
    s, y = s[order], y[order]
    right = y.sum() - np.r_[0, np.cumsum(y)] + np.r_[0, np.cumsum(1 - y)]  # ones above and zeros below each cut
    cuts = np.r_[s[0] - 0.01, (s[1:] + s[:-1]) / 2, s[-1] + 0.01]
    if right.max() == right[-1]:
        return MARGINS[0]
    best = cuts[right >= right.max() - 0.001 * len(s)]
    return float(max(MARGINS[-1], 0.75 * best.min() + 0.25 * best.max()))


def labelled_windows(documents: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """(key, label, fold, windows) of at most ``limit`` labelled documents, in hash order.

    The label is the raters' majority (ties and null labels drop out). Texts are cut whole, where
    they lie; documents of equal windows are one, with the label most of them have.
    """
    votes = labels.where("offensive in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg("offensive").alias("mean"))
    votes = votes.where("mean <> 0.5").select("doc_id", (F.col("mean") > 0.5).cast("int").alias("label"))
    votes = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [list(dict.fromkeys(windows(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.list_(pa.string()))], ["label", "windows"])

    texts = documents.select("doc_id", "text").where("text is not null").join(votes, "doc_id").select("label", "text")
    found = texts.mapInArrow(cut, "label int, windows array<string>").where(F.size("windows") > 0)
    found = found.groupBy(F.xxhash64("windows").alias("key")).agg(F.avg("label").alias("mean"), F.first("windows").alias("windows"))
    return found.select("key", (F.col("mean") >= 0.5).cast("int").alias("label"), F.pmod("key", F.lit(FOLDS)).cast("int").alias("fold"), "windows")


def _held_out(docs: DataFrame, margin: float | None) -> DataFrame:
    """The documents with ``d``, their windows' distances by dictionaries of the other folds; a fold is a task."""
    columns = [c for c in ("label", "windows", "d") if c in docs.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}
        for b in batches:
            for own, key, fold, *rest in zip(b["own"], b["key"], b["fold"], *(b[c] for c in columns)):
                held.setdefault(own, []).append((key, fold, (int(rest[0]), list(rest[1]), rest[2] if len(rest) > 2 else None)))
        for own, rows in held.items():
            model = Model(*train([doc for _, fold, doc in rows if fold != own], margin))
            mine = [(key, doc[0], own, doc[1], [model.distance(w) for w in doc[1]]) for key, fold, doc in rows if fold == own]
            yield pd.DataFrame(mine, columns=["key", "label", "fold", "windows", "d"])

    each = docs.withColumn("own", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))
    each = each.repartitionByRange(FOLDS, "own").select("own", "key", "fold", *columns)
    return each.mapInPandas(run, "key bigint, label int, fold int, windows array<string>, d array<float>")


def fit(documents: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, float]:
    """(toxic dictionary, ordinary dictionary, threshold). All training runs on the executors; the driver gets the finished dictionaries and one score a labelled document."""
    docs = cut_lineage(labelled_windows(documents, labels))
    for margin in (None, *MARGINS):
        docs = cut_lineage(_held_out(docs, margin))
    best = docs.select("label", F.array_max("d").alias("best")).collect()  # at most LABELLED rows of two numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(int(y), list(ws), d) for b in batches for y, ws, d in zip(b["label"], b["windows"], b["d"])]
        yield pd.DataFrame([train(rows, MARGINS[-1])], columns=["toxic", "ordinary"])

    made = docs.select("label", "windows", "d").coalesce(1).mapInPandas(run, "toxic binary, ordinary binary").first()
    threshold = calibrate([r["best"] for r in best], [r["label"] for r in best])
    return (bytes(made["toxic"]), bytes(made["ordinary"]), threshold) if made else (b"........", b"........", 1.0)


def score_documents(documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` and score, flagged for every row of documents.

    The score is the distance of the most toxic window (null and blank texts: -1, never flagged).
    Repeated rows are scored each for itself; collections without labels of both kinds have no
    flagged rows; null sources stay null.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))  # bounded by DICT_BYTES
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep) + ", score double, flagged boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            score = np.array([own.score(t) for t in batch.column(len(keep)).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score), pa.array(score > own.threshold)], [*keep, "score", "flagged"])

    return spread(documents.select(*keep, F.col("text").alias("__text"))).mapInArrow(run, schema)


def offensive_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """p9_found: doc_id of the documents with abusive, hateful or sexual content."""
    return score_documents(documents, labels, ("doc_id",)).where("flagged").select("doc_id")


def rates_by_source(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """source, docs, flagged, rate; documents without source are counted under null."""
    scored = score_documents(documents, labels, ("source",))
    return scored.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("flagged").cast("bigint")).alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"))
