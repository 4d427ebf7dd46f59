"""Problem 3: cutting oversized texts at natural boundaries, with overlap.

A hierarchy of separators (section, paragraph, line, sentence, word, character) is applied
recursively: a span is cut by the next finer separator only while it is too large. The
resulting spans are packed greedily up to the limit, and each following piece begins
``overlap`` characters before the end of the one before, so that dropping the overlaps and
joining the pieces gives the text back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1200
OVERLAP = 200
#: Separators from coarse to fine; a span ends after its separator.
LEVELS = tuple(
    re.compile(p)
    for p in (
        r"\f+|(?:[ \t\r]*\n){3,}|\n(?=(?:CHAPTER|Chapter|SECTION|Section)\b)",
        r"(?:[ \t\r]*\n){2,}",
        r"\n",
        r"(?<=[.!?…])[\"'”’)\]]*\s+|(?<=;)\s+",
        r"\s+",
    )
)
_RUN = re.compile(r"\S+")


def _cut(text: str, lo: int, hi: int, level: int, fit: int, limit: int) -> Iterator[tuple[int, int]]:
    """Spans covering text[lo:hi], each at most ``fit`` long, or up to ``limit`` if one word."""
    if hi - lo <= fit:
        yield lo, hi
        return
    if level < len(LEVELS):
        ends = [m.end() for m in LEVELS[level].finditer(text, lo, hi) if lo < m.end() < hi]
        for a, b in zip([lo, *ends], [*ends, hi]):
            yield from _cut(text, a, b, level + 1, fit, limit)
        return
    run = _RUN.search(text, lo, hi)
    word_end = run.end() if run else lo
    if lo < word_end <= lo + limit and word_end < hi:  # a word and then long white space
        yield lo, word_end
        lo = word_end
    if hi - lo <= limit:
        yield lo, hi
        return
    for a in range(lo, hi, fit):
        yield a, min(a + fit, hi)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``; one piece if it is within the limit, none if empty."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    out, start, end = [], 0, 0
    for a, b in _cut(text, 0, len(text), 0, limit - overlap, limit):
        if b - start > limit:
            out.append((start, end))
            # A word too long for piece and overlap together shortens the overlap.
            start = max(end - overlap, b - limit, start + 1)
        end = b
    out.append((start, end))
    return out


def longest_run(text: str) -> int:
    return max((m.end() - m.start() for m in _RUN.finditer(text)), default=0)


def oversized_pieces(
    df: DataFrame, keep: tuple[str, ...] = ("id", "doc", "page", "ordinal"), text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP
) -> DataFrame:
    """Pieces of the texts with more than ``limit`` characters after trimming white space.

    Gives ``keep`` and piece_no, n_pieces, start, text, boundary ('forced' if some run without
    white space exceeds the limit, else 'natural'). Null, blank and shorter texts give no row;
    repeated rows are cut each for itself; null key columns are carried along; further columns
    are ignored. Offsets count characters of the trimmed text.
    """
    keys = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join(f"{k} {df.schema[c].dataType.simpleString()}" for k, c in zip(keys, keep))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, raw in batch.itertuples(index=False):
                text = raw.strip()
                if len(text) <= limit:
                    continue
                spans = split_text(text, limit, overlap)
                kind = "forced" if longest_run(text) > limit else "natural"
                rows += [(*key, i, len(spans), a, text[a:b], kind) for i, (a, b) in enumerate(spans)]
            out = pd.DataFrame(rows, columns=[*keys, "piece_no", "n_pieces", "start", "text", "boundary"])
            for k in keys:  # nullable integers arrive as floats
                if batch.dtypes[k].kind == "f":
                    out[k] = out[k].astype("Float64")
            yield out

    longer = df.where(F.length(text_col) > limit).select(*[F.col(c).alias(k) for k, c in zip(keys, keep)], F.col(text_col).alias("t"))
    out = longer.mapInPandas(run, f"{schema}, piece_no int, n_pieces int, start int, text string, boundary string")
    return out.withColumnsRenamed(dict(zip(keys, keep)))


def oversized(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """p3_found: chunk_id and boundary of every oversized chunk, read off its first piece."""
    first = oversized_pieces(df, limit=limit, overlap=overlap).where("piece_no = 0")
    return first.select(F.col("id").alias("chunk_id"), "boundary")
