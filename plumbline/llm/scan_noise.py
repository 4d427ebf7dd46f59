"""Problem 1: repairing text that comes from scanned pages.

1. ``learn`` counts words and their neighbours over all texts (distributed), and turns the
   skip-gram counts into vectors: positive pointwise mutual information of the frequent words
   with the most frequent context words, reduced to ``DIMS`` dimensions. (Factorising these
   counts has the optimum of skip-gram with negative sampling, in one pass over the text.)
2. A rare word gets a vector of its own at each occurrence: that of its neighbours there, in the
   same space, and that of its letter sequences. It is linked to a frequent word if a plausible
   misreading of glyphs makes it from that word *and* their vectors are near; of several
   such words the nearest is taken. A word without near vectors is left alone.
3. Running headers and page numbers are removed, words cut at line ends are joined across
   whatever stands between, corrections are applied and the lines are reflowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage, spread

DIMS = 32
CONTEXTS = 400  # dimensions before reduction: the most frequent words, as in any co-occurrence model
FREQUENT = 2e-6  # least share of all words for a word to be in the lexicon
LEAST_COUNT = 4
RATIO = 25  # a word is rare beside another that is so many times as frequent
SIMILAR = 0.35  # least cosine of two linked words that both occur often
NEAR = 0.2  # least cosine of a rare word's vector, at its place, and that of the word it is linked to
SPELT = 24  # longer words are compared with the lexicon's words of their length, instead of writing out all their repairs
DOUBTED = 6  # lines after a cut word without other half whose first words are not doubted
FLUSH = 400_000

#: Misread glyphs and what they may stand for.
GLYPHS = (
    ("0", "o"), ("1", "i"), ("1", "l"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("@", "a"), ("$", "s"), ("|", "l"), ("|", "i"), ("!", "i"), ("!", "l"),
    ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("€", "e"), ("£", "e"), ("¢", "c"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("b", "e"), ("o", "e"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"), ("l", "i"), ("i", "l"), ("l", "t"), ("t", "l"), ("i", "j"), ("g", "q"), ("q", "g"), ("o", "c"), ("c", "o"), ("a", "o"),
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("ii", "u"), ("u", "ii"), ("nn", "m"), ("ri", "n"), ("li", "h"), ("lc", "k"), ("in", "m"), ("ni", "m"), ("rri", "m"),
)
#: Letters and marks misread for digits.
DIGITS = str.maketrans("OoQDlI|!iSsBZzgqbGTA", "00001111155822996674"[:20])

HYPHENS = "-­‐‑"
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_BREAK = re.compile(rf"[{HYPHENS}][^\S\n]*\n")
_FIRST = re.compile(r"[\W_]*?([^\W\d_]+(?:[-'’][^\W\d_]+)*)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_BARE_EDGE = re.compile(r"^[^\w@$|!€£]+|[^\w@$|€£]+$")

_NUM = r"[0-9lIO|oSB]{1,4}"
_PAGE = rf"(?:\[ ?{_NUM} ?\]|[-–—] ?{_NUM} ?[-–—]|[Pp][\w@]{{1,2}}[gq9][\w@]\.? {_NUM}|PAGE {_NUM}|{_NUM} (?:of|OF|0f|ot) {_NUM}|{_NUM}-{_NUM}|[ivxl]{{1,7}}|{_NUM})"
_TM = rf"(?P<tm>[A-Z]{{2,4}} {{0,3}}[0-9lIOoSB|]{{1,4}}(?:[-–][0-9lIOoSB|]{{1,5}}){{2,6}}(?:-?&[A-Z])?(?: {{0,3}}[A-Z][0-9lI]{{1,2}})?)"
_CHAP = r"(?P<chap>(?:[CG][HN][ARP4@]{1,3}[PF]?[TFI]?[A-Z]{1,2}|Ch[a@]?[pnq][tfl][a-z0-9]{1,2}|SECTION|Section|APPENDIX|Appendix|PART|Part) {0,3}[0-9A-ZlIO]{1,3} {0,3}[-–.:] {0,3}[A-Z0-9|@][^.!?;\n]{2,60})"
_TITLE = r"(?P<title>[A-Z0-9|@][\w|@'&/-]*(?: {1,2}(?:[A-Z0-9|@][\w|@'&/-]*|of|and|the|for|in|on|to)){1,8})"
#: Lines that may be furniture: a page number, a number of the manual, a chapter heading or a
#: title, each alone or beside a page number.
_FURNITURE = re.compile(rf"^[^\S\n]*(?:(?P<p1>{_PAGE})(?:[^\S\n]{{2,}}|[^\S\n]*$))?(?:(?:{_TM}|{_CHAP}|{_TITLE})(?:[^\S\n]{{2,}}(?P<p2>{_PAGE}))?)?[^\S\n]*$")
_MAY_BE_FURNITURE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789[-–—|@")
_BARE = re.compile(r"[0-9lIO|oSB]{1,4}")
_TABLE = re.compile(r"(?i)^\s*(?:item|qty|no\.?|ref|part|pos)\b.*\b(?:qty|quantity|no\.?|item|part)\s*$")
_LATIN_NUMBER = re.compile(r"[ivxl]+")
_LATIN_START = re.compile(r"[ivxl]{1,7}\s{2}")


@lru_cache(maxsize=50_000)
def glyph_repairs(word: str) -> frozenset[str]:
    """What ``word`` may have been: one misread glyph, or one kind of misreading at two places, or two kinds."""

    def once(w: str) -> set[str]:
        out = set()
        for seen, meant in GLYPHS:
            at = w.find(seen)
            while at >= 0:
                out.add(w[:at] + meant + w[at + len(seen) :])
                at = w.find(seen, at + 1)
        return out

    first = once(word)
    return frozenset(first if len(word) < 5 else first | {x for w in first for x in once(w)} - {word})


def is_glyph_repair(seen: str, meant: str, most: int = 2) -> bool:
    """Whether at most so many misread glyphs make ``seen`` of ``meant``; at least one. No pair of glyphs begins alike, so a misreading shows where the words part."""

    def walk(i: int, j: int, left: int) -> bool:
        while i < len(seen) and j < len(meant) and seen[i] == meant[j]:
            i, j = i + 1, j + 1
        if i == len(seen) and j == len(meant):
            return True
        return left > 0 and any(seen.startswith(x, i) and meant.startswith(y, j) and walk(i + len(x), j + len(y), left - 1) for x, y in GLYPHS)

    return seen != meant and walk(0, 0, most)


# ---- learning -------------------------------------------------------------------------------


class _Codes(dict):
    """Words numbered as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_APART = np.array([-1], dtype=np.int64)


def _pair_codes(ids: np.ndarray, apart: int) -> np.ndarray:
    a, b = ids[:-apart], ids[apart:]
    ok = (a >= 0) & (b >= 0)
    if apart == 2:
        ok &= ids[1:-1] >= 0
    return (a[ok] << 32) | b[ok]


def _without_cut_words(text: str) -> str:
    """The text without words cut by a line end, which would be counted as two wrong ones."""
    parts = _BREAK.split(text)
    if len(parts) == 1:
        return text
    for i in range(len(parts) - 1):
        left = parts[i]
        parts[i] = left[: max(left.rfind(" "), left.rfind("\n")) + 1]
        right = parts[i + 1].lstrip()
        parts[i + 1] = right[len(right.split(None, 1)[0]) :] if right else ""
    return "\n".join(parts)


def _count(texts: DataFrame) -> DataFrame:
    """(kind, a, b, n): words (kind 0) and pairs up to two words apart (kind 1), summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _Codes()
        words = np.zeros(0, dtype=np.int64)
        seen: list[np.ndarray] = []
        pairs, times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def settle() -> None:  # texts are kept apart by -1, so no pair spans two of them
            nonlocal words, pairs, times
            ids = np.concatenate(seen)
            seen.clear()
            n = np.bincount(ids[ids >= 0], minlength=len(code))
            n[: len(words)] += words
            words = n
            fresh = np.concatenate([_pair_codes(ids, 1), _pair_codes(ids, 2)])
            fresh, m = np.unique(fresh, return_counts=True)
            both, at = np.unique(np.concatenate([pairs, fresh]), return_inverse=True)
            pairs, times = both, np.bincount(at, np.concatenate([times, m]), len(both)).astype(np.int64)

        def rows() -> pa.RecordBatch:
            nonlocal words, pairs, times
            names = np.array([*code, ""], dtype=object)
            k = np.flatnonzero(words)
            a = np.concatenate([names[k], names[pairs >> 32]])
            b = np.concatenate([names[np.full(len(k), -1)], names[pairs & 0xFFFFFFFF]])
            n = np.concatenate([words[k], times])
            kind = np.r_[np.zeros(len(k), dtype=np.int8), np.ones(len(pairs), dtype=np.int8)]
            code.clear()
            words, pairs, times = words[:0], pairs[:0], times[:0]
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], ["kind", "a", "b", "n"])

        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = _WORD.findall(_without_cut_words(text.lower()))
                seen.append(np.fromiter(map(code.__getitem__, found), dtype=np.int64, count=len(found)))
                seen.append(_APART)
                size += len(found)
                if size > 2_000_000:
                    settle()
                    size = 0
                    if len(pairs) + len(code) > FLUSH:
                        yield rows()
        if seen:
            settle()
        yield rows()

    counts = spread(texts.where("text is not null").select("text")).mapInArrow(run, "kind tinyint, a string, b string, n bigint")
    return counts.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def _grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(1e-9, float(np.linalg.norm(v)))


class Lexicon:
    """Frequent words with counts and skip-gram vectors; of bounded size, as each has at least a share of ``FREQUENT``.

    ``counts`` also holds rarer words that look like misreadings but are too frequent for one.
    ``context`` has the vectors that words lend as neighbours (by default those of the words).
    """

    def __init__(self, counts: dict[str, int], vectors: dict[str, np.ndarray], context: dict[str, np.ndarray] | None = None):
        self.counts, self.vectors = counts, vectors
        self.context = vectors if context is None else context
        self.links: dict[str, tuple[str, ...]] = {}
        self.by_length: dict[int, list[str]] = {}
        for w in counts:
            if len(w) > SPELT - 4:
                self.by_length.setdefault(len(w), []).append(w)
        self._spelt: dict[str, np.ndarray | None] | None = None

    def cosine(self, a: str, b: str) -> float | None:
        x, y = self.vectors.get(a), self.vectors.get(b)
        return None if x is None or y is None else float(x @ y)

    def _repairs(self, word: str) -> list[str]:
        if len(word) <= SPELT:
            return [w for w in glyph_repairs(word) if w in self.counts]
        return [w for n in range(len(word) - 4, len(word) + 5) for w in self.by_length.get(n, ()) if is_glyph_repair(word, w)]

    def candidates(self, word: str) -> tuple[str, ...]:
        """Frequent words of which ``word`` is a plausible misreading by its glyphs and counts, the most frequent first."""
        if (known := self.links.get(word)) is not None:
            return known
        own = self.counts.get(word, 0)
        need = max(RATIO * max(own, 1), 2 * LEAST_COUNT)
        out = []
        if 2 < len(word) or not word.isalpha():
            for w in self._repairs(word):
                n = self.counts[w]
                if n >= need and (own < LEAST_COUNT or not word.isalpha() or (self.cosine(word, w) or 0.0) >= SIMILAR):
                    out.append((n, w))
        if not out and not own and "-" in word:  # compounds: the parts one by one
            parts = [(p,) if self.counts.get(p, 0) >= 2 * LEAST_COUNT else self.candidates(p)[:1] for p in word.split("-")]
            if all(parts) and len(parts) == 2:
                joined = ["-".join(x) for x in product(*parts)]
                out = [(1, w) for w in joined if w != word and self.counts.get(w, 0) >= LEAST_COUNT]
        self.links[word] = out = tuple(w for _, w in sorted(out, reverse=True))
        return out

    def spelt(self, word: str) -> np.ndarray | None:
        """The vector of a word's letter sequences: each has the mean vector of the frequent words with it."""
        if self._spelt is None:
            sums: dict[str, np.ndarray] = {}
            for w, v in self.vectors.items():
                for g in _grams(w):
                    sums[g] = sums[g] + v if g in sums else v.astype(np.float32)
            self._spelt = {g: _unit(v) for g, v in sums.items()}
        found = [v for g in _grams(word) if (v := self._spelt.get(g)) is not None]
        return _unit(np.sum(found, axis=0)) if found else None

    def best(self, word: str, around: list[str]) -> str | None:
        """The word that ``word`` stands for between its neighbours: the candidate of the nearest vector, if one is near."""
        found = [w for w in self.candidates(word) if w in self.vectors]
        if not found:
            return None
        lent = [v for w in around if (v := self.context.get(w)) is not None]
        parts = [_unit(np.sum(lent, axis=0))] if lent else []
        if (v := self.spelt(word)) is not None:
            parts.append(v)
        if not parts:
            return None
        here = _unit(np.sum(parts, axis=0))
        near = {w: fit for w in found if (fit := float(here @ self.vectors[w])) >= NEAR}
        return max(near, key=lambda w: near[w] + 0.05 * np.log(self.counts[w])) if near else None

    def parts(self) -> tuple:
        """What is sent to the executors: names, counts and half-precision vectors."""
        pack = lambda d: (list(d), np.array([*d.values()], dtype=np.float16))
        return self.counts, pack(self.vectors), pack(self.context)

    @classmethod
    def of_parts(cls, counts: dict[str, int], vectors: tuple, context: tuple) -> Lexicon:
        unpack = lambda p: dict(zip(p[0], p[1].astype(np.float32)))
        return cls(counts, unpack(vectors), unpack(context))


def _too_frequent(words: DataFrame, lexicon: dict[str, int], least: float) -> dict[str, int]:
    """Words below the lexicon's share that have a frequent word's glyphs but more than its ``RATIO``-th part of its count: no misreadings.

    Only words with more than 1 / RATIO of the least count can be, so there are at most RATIO / FREQUENT.
    """
    shared = words.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(shared.value, {})
        for batch in batches:
            keep = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if any(lex.counts[c] < RATIO * n for c in lex._repairs(w))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in keep], pa.string()), pa.array([n for _, n in keep], pa.int64())], ["a", "n"])

    rare = words.where((F.col("n") < least) & (F.col("n") >= max(LEAST_COUNT, least / RATIO))).select("a", "n")
    return {r["a"]: r["n"] for r in rare.mapInArrow(run, "a string, n bigint").toLocalIterator()}


def _vectors(counts: DataFrame, lexicon: dict[str, int], contexts: list[str]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(vectors of words, vectors that context words lend), from the counted pairs.

    Word rows stay on the executors; the driver gets the contexts' sums, their products with each
    other (``CONTEXTS`` squared) and the finished vectors of ``DIMS`` numbers.
    """
    spark = counts.sparkSession
    ctx = F.broadcast(spark.createDataFrame([(w, i) for i, w in enumerate(contexts)], "c string, i int"))
    lex = F.broadcast(spark.createDataFrame([(w,) for w in lexicon], "w string"))  # at most 1 / FREQUENT words
    both = counts.where("kind = 1")
    both = both.select(F.col("a").alias("w"), F.col("b").alias("c"), "n").unionByName(both.select(F.col("b").alias("w"), F.col("a").alias("c"), "n"))
    cells = both.join(ctx, "c").join(lex, "w").groupBy("w", "i").agg(F.sum("n").alias("n"))
    rows = cut_lineage(cells.groupBy("w").agg(F.collect_list(F.struct("i", "n")).alias("cells")).repartition(16))  # at most CONTEXTS cells a word
    sums = {r["i"]: r["n"] for r in rows.select(F.inline("cells")).groupBy("i").agg(F.sum("n").alias("n")).collect()}
    share = np.array([sums.get(i, 0) for i in range(len(contexts))], dtype=np.float64) ** 0.75  # smoothed by the usual power
    share /= max(1e-9, share.sum())

    def information(cells: pa.Array) -> np.ndarray:
        """Positive pointwise mutual information, a row a word."""
        m = np.zeros((len(cells), len(contexts)), dtype=np.float64)
        flat = cells.flatten()
        at = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
        m[at, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
        m /= np.maximum(m.sum(axis=1, keepdims=True), 1) * np.maximum(share, 1e-12)
        np.log(m, out=m, where=m > 0)
        return np.maximum(m, 0)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(contexts), len(contexts)))
        for b in batches:
            m = information(b.column(0))
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    gram = np.zeros((len(contexts), len(contexts)))
    for r in rows.select("cells").mapInArrow(products, "m binary").toLocalIterator():  # one a task, 16 tasks
        gram += np.frombuffer(bytes(r["m"])).reshape(gram.shape)
    axes = np.linalg.eigh(gram)[1][:, ::-1][:, :DIMS]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = information(b.column(1)) @ axes
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v.astype(np.float16)], pa.binary())], ["w", "v"])

    made = rows.select("w", "cells").mapInArrow(reduce, "w string, v binary")
    vectors = {r["w"]: np.frombuffer(bytes(r["v"]), dtype=np.float16).astype(np.float32) for r in made.toLocalIterator()}
    # A neighbour seen once has this much information, which is what a word of one occurrence would be made of.
    weight = -np.log(np.maximum(share, 1e-12))
    return vectors, {w: (weight[i] * axes[i]).astype(np.float32) for i, w in enumerate(contexts)}


def learn(texts: DataFrame) -> Lexicon:
    """Lexicon and skip-gram vectors over all texts of the column ``text``."""
    counts = cut_lineage(_count(texts))
    words = counts.where("kind = 0")
    total = words.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_COUNT, FREQUENT * total)
    lexicon = {r["a"]: r["n"] for r in words.where(F.col("n") >= least).select("a", "n").toLocalIterator()}  # at most 1 / FREQUENT words
    if not lexicon:
        return Lexicon({}, {})
    contexts = [w for w, _ in sorted(lexicon.items(), key=lambda x: (-x[1], x[0]))[:CONTEXTS]]
    vectors, context = _vectors(counts, lexicon, contexts)
    return Lexicon(lexicon | _too_frequent(words, lexicon, least), vectors, context)


# ---- repairing ------------------------------------------------------------------------------


def _manual_words(doc: str | None) -> tuple[str, set[str]]:
    """Digits of the manual's number and the words of its name, from the file name."""
    name = re.sub(r"^.*[/\\]|\.[A-Za-z]+$", "", doc or "").lower()
    return re.sub(r"\D", "", name), {w for w in re.split(r"[^a-z]+", name) if len(w) > 2}


def _is_title(line: str, name: set[str], lex: Lexicon) -> bool:
    """A title names the manual's subject in capitals or title case."""
    words = line.split()
    if not (2 <= len(words) <= 9 and sum(w[0].isupper() or w[0].isdigit() for w in words) >= len(words) - 1):
        return False
    hits = 0
    for w in words:
        w = w.lower().strip(",.")
        if w in name or any(c in name for c in glyph_repairs(w)):
            hits += 1
    return hits >= min(2, len(name)) and hits > 0


class Page:
    """One chunk's lines, and what is wrong with them."""

    def __init__(self, text: str, doc: str | None, page: int | None, lex: Lexicon):
        self.text, self.lex = text, lex
        self.furniture: set[int] = set()
        self.noise: set[str] = set()
        self.lines = text.split("\n")
        self._find_furniture(doc, page)

    def _find_furniture(self, doc: str | None, page: int | None) -> None:
        digits, name = None, None
        bare: list[int] = []
        for i, line in enumerate(self.lines):
            bare_line = line.strip()
            if not bare_line or bare_line[0] not in _MAY_BE_FURNITURE and len(bare_line) > 12 and not _LATIN_START.match(bare_line):
                continue
            m = _FURNITURE.match(line)
            if not m:
                continue
            number = m["p1"] or m["p2"]
            beside = m["tm"] or m["chap"] or m["title"]
            if beside:
                if digits is None:
                    digits, name = _manual_words(doc)
                if m["tm"]:
                    own = re.sub(r"\D", "", re.sub(r" *[A-Z][0-9lI]{1,2}$", "", m["tm"]).translate(DIGITS))
                    header = not digits or own.endswith(digits[-6:]) or digits.startswith(own[-8:]) or own[-8:] in digits
                elif m["chap"]:
                    header = not m["chap"].rstrip().endswith((",", "-")) and sum(w[:1].isupper() or w[:1].isdigit() for w in m["chap"].split()) >= len(m["chap"].split()) / 2
                else:
                    header = _is_title(m["title"], name, self.lex)
                if not header:
                    continue
                self.noise.add("header")
                if number:
                    self.noise.add("page_number")
                self.furniture.add(i)
            elif number:
                s = number.strip()
                if _BARE.fullmatch(s):
                    if re.search(r"\d", s):
                        bare.append(i)
                elif re.search(r"\d", s) or _LATIN_NUMBER.fullmatch(s) or re.match(r"\[|[-–—]|[Pp]", s):
                    self.noise.add("page_number")
                    self.furniture.add(i)
        for i in bare:  # figures standing one below another are a table
            before = next((j for j in range(i - 1, -1, -1) if self.lines[j].strip()), -1)
            after = next((j for j in range(i + 1, len(self.lines)) if self.lines[j].strip()), -1)
            if before in bare or after in bare or (before >= 0 and _TABLE.match(self.lines[before])):
                continue
            self.noise.add("page_number")
            self.furniture.add(i)

    def joints(self) -> list[tuple[int, int, str, str, str]]:
        """(line, line of the other half, first half, other half, the whole word) of words cut by a line end.

        ``loose`` gets the lines that begin, ``open_ends`` those that end, with what may be a part of
        a word whose other part was not found.
        """
        out = []
        self.loose, self.open_ends = set(), set()
        first = next((i for i, x in enumerate(self.lines) if x.strip() and i not in self.furniture), None)
        if first is not None and self.lines[first].lstrip()[:1].islower():
            self.loose.add(first)  # the chunk may begin within a word
        if not _BREAK.search(self.text):
            return out
        counts = self.lex.counts
        for i, line in enumerate(self.lines[:-1]):
            end = line.rstrip()
            if not end or end[-1] not in HYPHENS or i in self.furniture or len(end) < 2 or not end[-2].isalpha():
                continue
            a = re.search(r"[^\W\d_]+(?:-[^\W\d_]+)*$", end[:-1])
            if not a:
                continue
            a, fallback = a[0], None
            self.open_ends.add(i)
            passed = set()
            for j in range(i + 1, len(self.lines)):
                if j in self.furniture or not self.lines[j].strip():
                    continue
                m = _FIRST.match(self.lines[j])
                if not m or self.lines[j].lstrip()[:1].isdigit():
                    continue
                b = m[1]
                if j <= i + DOUBTED:
                    passed.add(j)
                solid, dashed = counts.get((a + b).lower(), 0), counts.get(f"{a}-{b}".lower(), 0)
                if solid or dashed:
                    out.append((i, j, a, b, a + b if solid >= dashed or end[-1] != "-" and solid else f"{a}-{b}"))
                    fallback = None
                    break
                if b[:1].islower() and self.lex.best((a + b).lower(), self._around(i, j)):
                    out.append((i, j, a, b, a + b))
                    if not self._clean(a + b):
                        self.noise.add("ocr")
                    fallback = None
                    break
                if fallback is None and b[:1].islower():
                    fallback = (i, j, a, b)
            if fallback is None and not (out and out[-1][0] == i):
                self.loose |= passed
            if fallback:
                i, j, a, b = fallback
                whole = counts.get(a.lower(), 0) >= 4 * LEAST_COUNT and counts.get(b.lower(), 0) >= 4 * LEAST_COUNT and len(a) > 2 and len(b) > 2
                out.append((i, j, a, b, f"{a}-{b}" if whole and end[-1] == "-" else a + b))
        return out

    def _around(self, i: int, j: int) -> list[str]:
        """The words before the first half of a cut word and after the other."""
        return [_EDGE.sub("", w).lower() for w in self.lines[i].split()[-3:-1] + self.lines[j].split()[1:3]]

    def _clean(self, word: str) -> bool:
        return word.lower() in self.lex.counts


_NUMBER_LIKE = re.compile(r"(?:(?=[^\W_]*\d)(?=[^\W_]*[OoQDlI|SsBZzgi!])[\dOoQDlI|SsBZzgi!]+|[lI|]\d+|\d+[lIOo|])(?:[.\-/][\dOoQDlI|]+)*")
_CODE = re.compile(r"[A-Z]{1,3}(?=[\dOolI|SB-]*\d)(?=\d*[OolI|SB])[\dOolI|SB]{3,}(?:-[\dOolI|SB]+)*")
_PLAIN_NUMBER = re.compile(r"[\d.,:/%°+-]*")
#: What may follow a figure or stand in one without being misread.
_UNIT_LIKE = re.compile(r"\d+(?:s|S|l|g|i|I|B|x|th|st|nd|rd|D|in|W\d+|w\d+)|(?![SBOI]\d\d)[A-Z]\d{1,2}|\d{1,2}[A-Z]")
_AMBIGUOUS = re.compile(r"\d+[sSlgiIBO]")
_MEASURE = re.compile(r"(?:mm|cm|psi|kPa|bar|volts?|amps?|rpm|quarts?|gallons?|ft-lbs?|N-m|degrees|minutes|hours|bolts|percent|kg|lb)\b")


def misread(token: str, lex: Lexicon) -> bool | None:
    """Whether a token without white space is a misread word or number; None: a word with candidates to weigh in context."""
    bare = _BARE_EDGE.sub("", token)
    if not bare or _PLAIN_NUMBER.fullmatch(bare):
        return False
    low = bare.lower().replace("’", "'")
    if low.isalpha() and lex.counts.get(low, 0) >= LEAST_COUNT and not lex.candidates(low):
        return False
    if any(ch.isdigit() for ch in bare):
        if _CODE.fullmatch(bare):
            return True
        if _NUMBER_LIKE.fullmatch(bare) and not _UNIT_LIKE.fullmatch(bare):
            return True
        if _AMBIGUOUS.fullmatch(bare):  # a unit, unless a unit follows
            return True
        if _UNIT_LIKE.fullmatch(bare):
            return False
    return None if lex.candidates(low) else False


def repair(text: str, doc: str | None, page: int | None, lex: Lexicon, sound: set[str], rewrite: bool) -> tuple[set[str], str | None]:
    """The kinds of noise in a chunk and, if wanted, its text in readable paragraphs."""
    p = Page(text, doc, page, lex)
    joints = p.joints()
    skip_start = {j for _, j, _, _, _ in joints}
    for _, _, a, b, whole in joints:
        if whole == a + b:
            p.noise.add("hyphen")
    fixes: dict[str, str] = {}
    fresh = set(text.split()) - sound
    if fresh:
        doubtful, verdicts = set(), {}
        for t in fresh:
            verdict = misread(t, lex)
            if verdict is False:
                if len(sound) < 2_000_000:
                    sound.add(t)
            else:
                doubtful.add(t)
                verdicts[t] = verdict
        if doubtful:
            for i, line in enumerate(p.lines):
                if i in p.furniture:
                    continue
                words = line.split()
                for k, t in enumerate(words):
                    if t not in doubtful:
                        continue
                    if k == len(words) - 1 and i in p.open_ends or k == 0 and (i in skip_start or i in p.loose):
                        continue
                    bare = _BARE_EDGE.sub("", t)
                    if verdicts[t] and _AMBIGUOUS.fullmatch(bare) and not (k + 1 < len(words) and _MEASURE.match(words[k + 1])):
                        continue
                    if verdicts[t]:
                        p.noise.add("ocr")
                        fixes[t] = t.replace(bare, re.sub(r"(?<![A-Za-z])[A-Za-z]{0,3}(?=\d)|.", lambda m: m[0] if len(m[0]) > 1 else m[0].translate(DIGITS), bare)) if not bare[0].isalpha() or bare[0] in "lIOo" else t
                        continue
                    around = [_EDGE.sub("", w).lower() for w in words[max(0, k - 2) : k] + words[k + 1 : k + 3]]
                    best = lex.best(bare.lower(), around)
                    if best:
                        p.noise.add("ocr")
                        best = best.upper() if bare.isupper() and len(bare) > 1 else best.capitalize() if bare[:1].isupper() or not bare[:1].isalpha() and k == 0 else best
                        fixes[t] = t.replace(bare, best)
    if not rewrite:
        return p.noise, None
    lines: list[str | None] = [None if i in p.furniture else " ".join(fixes.get(t, t) for t in line.split()) for i, line in enumerate(p.lines)]
    for i, j, a, b, whole in joints:
        if lines[i] is None or lines[j] is None:
            continue
        head = lines[i].rstrip(HYPHENS + " ")
        best = whole if p._clean(whole) else lex.best(whole.lower(), p._around(i, j)) or whole
        lines[i] = head[: len(head) - len(a)] + best if head.endswith(a) else head + b
        rest = lines[j].lstrip()
        lines[j] = rest[len(b) :].lstrip() if rest.startswith(b) else rest
        if lines[j][:1] in ".,;:)":
            lines[i] += lines[j][:1]
            lines[j] = lines[j][1:].lstrip()
    out, current = [], []
    for i, line in enumerate(lines):
        if line is None:
            continue
        row = re.search(r"\S {2,}\S", p.lines[i]) is not None and len(p.lines[i]) < 60 or _BARE.fullmatch(p.lines[i].strip())
        if not line or row:
            out += [" ".join(current)] if current else []
            out += [line] if row else []
            current = []
        else:
            current.append(line)
    out += [" ".join(current)] if current else []
    return p.noise, "\n\n".join(out)


def _apply(df: DataFrame, lex: Lexicon, rewrite: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(lex.parts())  # bounded, see Lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sound = Lexicon.of_parts(*shared.value), set()
        for batch in batches:
            ids, kinds, texts = [], [], []
            for cid, doc, page, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                noise, fixed = repair(text, doc, page, own, sound, rewrite) if text else (set(), text)
                if rewrite:
                    ids.append(cid), texts.append(fixed)
                else:
                    kinds += sorted(noise)
                    ids += [cid] * len(noise)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts if rewrite else kinds, pa.string())], ["chunk_id", "v"])

    return spread(df.select(F.col("id").cast("bigint"), "doc", F.col("page").cast("int"), "text")).mapInArrow(run, "chunk_id bigint, v string")


def scan_noise(df: DataFrame) -> DataFrame:
    """p1_found: (chunk_id, noise) for each kind of noise found in a chunk's text.

    Kinds: hyphen, ocr, header, page_number. Null, empty and blank texts have none. Repeated
    rows are judged each for itself. A null doc leaves headers to their form alone; ``page`` is
    not needed. Long texts are searched whole.
    """
    return _apply(df.where("text is not null"), learn(df), False).withColumnRenamed("v", "noise")


def readable_text(df: DataFrame) -> DataFrame:
    """(chunk_id, text): every chunk's text in continuous paragraphs; null stays null, blank becomes empty."""
    return _apply(df, learn(df), True).withColumnRenamed("v", "text")
