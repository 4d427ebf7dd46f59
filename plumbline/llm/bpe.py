"""Problem 7: whole-corpus encoding with a byte-level BPE vocabulary.

The merge loop runs on numpy matrices. Pre-tokens of similar length share one padded matrix
of token ids; in each round every row merges its leftmost pair of least rank, ranks being
looked up in an open-addressing hash table, and the matrix is compacted by one column. Rows
longer than ``LONG_ROW`` merge all occurrences of their least rank in one round instead, which
gives the same ids in far fewer rounds.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import spread

#: Fixed value: the public pre-tokenisation pattern of this vocabulary.
PRETOKEN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NO_RANK = np.int32(2**31 - 1)
LONG_ROW = 192
CACHE_LIMIT = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> merged id, with linear probing over power-of-two arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(max(len(merged), 1) * 3))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.vals = np.full(1 << self.bits, NO_RANK, dtype=np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            _, first = np.unique(slot[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[slot[placed]], self.vals[slot[placed]] = keys[placed], merged[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slot[todo] = (slot[todo] + (self.keys[slot[todo]] != -1)) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of same-shaped arrays; NO_RANK where a pair does not merge or is padding."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        shape, keys = keys.shape, keys.ravel()
        slot = self._home(keys)
        out = np.full(len(keys), NO_RANK, dtype=np.int32)
        found = self.keys[slot] == keys
        out[found] = self.vals[slot[found]]
        todo = np.flatnonzero(~found & (self.keys[slot] != -1) & (keys >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            here = self.keys[slot[todo]]
            hit = todo[here == keys[todo]]
            out[hit] = self.vals[slot[hit]]
            todo = todo[(here != keys[todo]) & (here != -1)]
        return out.reshape(shape)


class ByteBpe:
    """Encoder over the ranks of a tiktoken-format vocabulary file."""

    def __init__(self, raw: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        byte_ids = np.full(256, -1, dtype=np.int32)
        left, right, merged = [], [], []
        for token, rank in self.rank.items():
            if len(token) == 1:
                byte_ids[token[0]] = rank
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.byte_ids = byte_ids
        self.pairs = PairTable(np.array(left), np.array(right), np.array(merged, dtype=np.int32))
        self.known: dict[str, list[int]] = {}

    def merge_long(self, row: np.ndarray) -> np.ndarray:
        ranks = self.pairs.ranks(row[:-1], row[1:])
        while len(row) > 1:
            least = ranks.min()
            if least == NO_RANK:
                break
            at = np.flatnonzero(ranks == least)
            start = np.r_[True, np.diff(at) != 1]
            offset = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[offset % 2 == 0]
            row[at] = least
            row = np.delete(row, at + 1)
            ranks = self.pairs.ranks(row[:-1], row[1:])
        return row

    def merge_matrix(self, rows: np.ndarray) -> list[np.ndarray]:
        """Rows of token ids padded with -1 at the right; the final ids of each row."""
        out: list[np.ndarray] = [None] * len(rows)  # type: ignore[list-item]
        index = np.arange(len(rows))
        ranks = self.pairs.ranks(rows[:, :-1], rows[:, 1:])
        while len(index):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(index), dtype=np.int64)
            live = ranks[np.arange(len(index)), at] != NO_RANK if ranks.shape[1] else np.zeros(len(index), dtype=bool)
            for k, row in zip(index[~live], rows[~live]):
                out[k] = row[row >= 0]
            if not live.any():
                break
            rows, ranks, index, at = rows[live], ranks[live], index[live], at[live]
            n, width = rows.shape
            line = np.arange(n)
            rows[line, at] = ranks[line, at]
            keep = np.ones((n, width), dtype=bool)
            keep[line, at + 1] = False
            rows = rows[keep].reshape(n, width - 1)
            keep = keep[:, 1:]
            ranks = ranks[keep].reshape(n, width - 2)
            if width > 2:
                right = at < width - 2
                ranks[line[right], at[right]] = self.pairs.ranks(rows[line[right], at[right]], rows[line[right], at[right] + 1])
                before = at > 0
                ranks[line[before], at[before] - 1] = self.pairs.ranks(rows[line[before], at[before] - 1], rows[line[before], at[before]])
        return out

    def learn(self, pieces: list[str]) -> None:
        """Encode pre-tokens not seen before, bucketed by length."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (whole := self.rank.get(raw)) is not None:
                self.known[piece] = [whole]
            elif len(raw) > LONG_ROW:
                self.known[piece] = self.merge_long(self.byte_ids[np.frombuffer(raw, dtype=np.uint8)]).tolist()
            else:
                buckets.setdefault(len(raw) if len(raw) <= 16 else -(-len(raw) // 16) * 16, []).append((piece, raw))
        for width, members in buckets.items():
            for lo in range(0, len(members), 65536 // width * 8):
                part = members[lo : lo + 65536 // width * 8]
                rows = np.full((len(part), width), -1, dtype=np.int32)
                for i, (_, raw) in enumerate(part):
                    rows[i, : len(raw)] = self.byte_ids[np.frombuffer(raw, dtype=np.uint8)]
                for (piece, _), ids in zip(part, self.merge_matrix(rows)):
                    self.known[piece] = ids.tolist()

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [PRETOKEN.findall(t) if t else [] for t in texts]
        if len(self.known) > CACHE_LIMIT:
            self.known.clear()
        fresh = {p for pieces in split for p in pieces} - self.known.keys()
        if fresh:
            self.learn(list(fresh))
        known = self.known
        return [[i for p in pieces for i in known[p]] for pieces in split]


_ENCODERS: dict[int, ByteBpe] = {}


def encoder(raw: bytes) -> ByteBpe:
    """One encoder per Python worker and vocabulary."""
    key = hash(raw)
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteBpe(raw)
    return _ENCODERS[key]


def _vocab(df: DataFrame, path: str):
    # The vocabulary is a fixed file of under 1 MB, so broadcasting it is bounded.
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _batches(texts: list[str | None], limit: int = 4_000_000) -> Iterator[slice]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > limit and i > lo:
            yield slice(lo, i)
            lo, size = i, len(t or "")
    yield slice(lo, len(texts))


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str = DEFAULT_VOCAB) -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens.

    Null and empty texts give the empty list; rows with equal ids stay separate rows; other
    columns of ``df`` are ignored, whatever their names. Very long texts are encoded whole.
    """
    vocab, kind = _vocab(df, vocab_path), df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocab.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _batches(texts):
                ids = pa.array(bpe.encode_batch(texts[part]), type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), ids], ["id", "ids"])

    return spread(df.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", vocab_path: str = DEFAULT_VOCAB) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of token ids of the text (0 for null and empty)."""
    vocab = _vocab(df, vocab_path)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocab.value)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            sizes = [n for part in _batches(texts) for n in map(len, bpe.encode_batch(texts[part]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, type=pa.int64())], [*keep, "tokens"])

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)
