"""Problem 4: most similar vectors, by collision-counting hashing.

Every vector is projected on random orthogonal directions, each a hash function of its own. Two
vectors collide on a projection if their values lie within a window of each other. Rows are held
as arrays sorted by projection; a query looks up the window centred on its own value in each, rows
met in enough windows are verified with their exact cosine.

* ``nearest`` (k nearest of given queries): windows grow (virtual rehashing) from a small radius by
  a fixed factor until the kth best verified row lies within the radius they stand for; the
  radius reached for one batch of rows is where the next batch starts.
* ``similar_pairs`` (all pairs from a cosine up): the cosine sets the radius, so windows have their
  last width at once. A single projection keeps nearly half of all rows in such a window, so
  rows meet in cells of rotated compound projections first: over several tables, a row's cell is the
  axis it lies closest to under random rotations; sorted arrays and windows are those of a cell.
  Equal vectors are one class, which is searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import cut_lineage, small_side

SEED = 7
PROJECTIONS = 24
CELL_ROWS = 1024  # wanted rows in a cell
RECALL = 0.999  # wanted chance that a pair of the least cosine is met in some cell
HEAVY = 4096  # larger cells are split into pairs of blocks
WIDTHS = 2.6  # window radius in standard deviations of a pair's difference
GRID = 64.0  # projections are kept in steps of 1/GRID of a typical vector's deviation
COPIES = 10  # classes of equal vectors are written as all their pairs up to so many rows, larger ones as pairs with their first row

SEARCH_PROJECTIONS = 64
SEARCH_WIDTH = 1.0  # window radius of the search, in the same measure
SEARCH_LEAST = 0.62  # a row must collide on this share of the projections to be verified
GROWTH = 1.15  # windows grow by this factor
FIRST_RADIUS = 0.25
QUERY_BLOCK = 16384


def usable_vectors(df: DataFrame) -> DataFrame:
    """(chunk_id, vec): the last written vector of each chunk, if it is usable.

    Of the rows of a chunk the one with the last ``written_at`` counts (null dates come first;
    of several at one time the least vector, so the result is defined). The chunk is dropped
    if that row's vector is null, all zero, has a null or non-finite number or not ``dim`` numbers.
    """
    cols = F.struct(F.col("written_at"), (-F.coalesce(F.size("vec"), F.lit(0))).alias("s"), F.col("dim"), F.col("vec"))
    last = df.where("chunk_id is not null").groupBy("chunk_id").agg(F.max(cols).alias("r")).select("chunk_id", "r.dim", "r.vec")
    zero = F.lit(0.0).cast("float")
    good = (F.size("vec") == F.col("dim")) & F.exists("vec", lambda x: x != zero) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return last.where(F.col("vec").isNotNull() & good).select("chunk_id", "vec")


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column, scaled to length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(-1, dim).astype(np.float32, copy=True)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return rows


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    """n unit directions in columns, orthogonal in groups of ``dim``."""
    rng = np.random.default_rng(seed)
    blocks = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(max(1, -(-n // dim)))]
    return np.concatenate(blocks, axis=1)[:, :n].astype(np.float32)


def components(dim: int, rows: float) -> list[int]:
    """How many axes each rotation of a compound hash has, so that cells hold about 1 / ``rows`` of all rows. m axes give 2 m codes."""
    bits, most = max(0, math.ceil(math.log2(max(1.0, rows)))), 1 << int(math.log2(dim))
    full = int(math.log2(2 * most))
    return [most] * (bits // full) + ([1 << (bits % full - 1)] if bits % full else [])


def compound_codes(rows: np.ndarray, rotations: np.ndarray, axes: list[int], tables: int) -> np.ndarray:
    """(rows, tables): in each table the nearest signed axes of the row's rotations, as one number."""
    turned = rows @ rotations
    out, at = np.zeros((len(rows), tables), dtype=np.int64), 0
    for t in range(tables):
        for m in axes:
            part = turned[:, at : at + m]
            near = np.abs(part).argmax(axis=1)
            out[:, t] = out[:, t] * (2 * m) + 2 * near + (part[np.arange(len(part)), near] > 0)
            at += m
    return out


def rotations(dim: int, axes: list[int], tables: int) -> np.ndarray:
    """Axes in columns; those of one rotation are orthogonal."""
    rng = np.random.default_rng(SEED)
    each = [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :m] for _ in range(tables) for m in axes]
    return np.concatenate(each, axis=1).astype(np.float32) if each else np.zeros((dim, 0), dtype=np.float32)


@lru_cache(maxsize=64)
def table_count(dim: int, cosine: float, axes: tuple[int, ...], recall: float = RECALL) -> int:
    """Tables needed so that a pair of this cosine is met in one of them.

    The chance to share a cell is estimated from random pairs of that cosine; that of lying in the
    window of the cell's sorted array follows from ``WIDTHS``.
    """
    if not axes:
        return 1
    rng, trials, tables = np.random.default_rng(SEED + 9), 8000, 8
    x, r = rng.standard_normal((2, trials, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r -= (r * x).sum(axis=1, keepdims=True) * x
    r /= np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * r
    turn = rotations(dim, list(axes), tables)
    same = float((compound_codes(x, turn, list(axes), tables) == compound_codes(y, turn, list(axes), tables)).mean())
    same *= 1 - math.erfc(WIDTHS / math.sqrt(2))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - max(same, 1e-3))))


def collision_threshold(dim: int) -> int:
    """Least number of colliding projections: all but those expected to miss, and four deviations more."""
    miss = math.erfc(WIDTHS / math.sqrt(2)) * PROJECTIONS
    return PROJECTIONS - math.ceil(miss + 4 * math.sqrt(miss))


def _cells(vectors: DataFrame, dim: int, axes: list[int], tables: int) -> DataFrame:
    """(cell, id, sig): per table the row's cell and its projections on a byte grid. The cell's last digits in base ``PROJECTIONS`` name the projection its array is sorted by."""
    turn = rotations(dim, axes, tables)
    lines = directions(dim, PROJECTIONS, SEED + 1)
    scale = GRID * math.sqrt(dim) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, rows = batch.column(0), unit_rows(batch.column(1), dim)
            number = np.arange(tables, dtype=np.int64)
            cell = (compound_codes(rows, turn, axes, tables) * tables + number) * PROJECTIONS + number % PROJECTIONS
            grid = np.clip(np.rint(rows @ lines * scale), -127, 127).astype(np.int8)
            sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PROJECTIONS), len(grid), [None, pa.py_buffer(grid.tobytes())]).cast(pa.binary())
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(cell[:, t]), ids, sig], ["cell", "id", "sig"])

    return vectors.select("chunk_id", "vec").mapInArrow(run, "cell bigint, id bigint, sig binary")


def _collide(sig: np.ndarray, other: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (row of sig, row of other) that collide on at least ``least`` projections and lie near by all of them; projections are rows here."""
    misses = np.zeros((sig.shape[1], other.shape[1]), dtype=np.uint8)
    half = PROJECTIONS // 2
    for p in range(half):
        misses += np.abs(sig[p][:, None] - other[p][None, :]) > window
    a, b = np.nonzero(misses <= PROJECTIONS - least)
    if len(a):
        rest = (np.abs(sig[half:, a] - other[half:, b]) > window).sum(axis=0) + misses[a, b]
        keep = rest <= PROJECTIONS - least
        a, b = a[keep], b[keep]
        # A window of WIDTHS deviations: the sum of squares of a pair at the border stays under this bound but for one in a million.
        most = (PROJECTIONS + 7 * math.sqrt(2 * PROJECTIONS)) * (window / WIDTHS) ** 2
        keep = (np.square((sig[:, a] - other[:, b]).astype(np.int32)).sum(axis=0)) <= most
        a, b = a[keep], b[keep]
    return a, b


def _windows(one: np.ndarray, two: np.ndarray | None, by: int, window: int, least: int, step: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Colliding rows of two arrays of projections (of one with itself if ``two`` is None), as index pairs.

    Both are sorted by projection ``by``; queries are taken in stretches of neighbours, whose windows
    are one range of the other array.
    """
    first = np.argsort(one[:, by], kind="stable")
    second = first if two is None else np.argsort(two[:, by], kind="stable")
    held = np.ascontiguousarray((one if two is None else two)[second].T)
    for lo in range(0, len(first), step):
        part = first[lo : lo + step]
        values = one[part, by]
        start = lo if two is None else int(np.searchsorted(held[by], values[0] - window, "left"))
        end = int(np.searchsorted(held[by], values[-1] + window, "right"))
        a, b = _collide(np.ascontiguousarray(one[part].T), held[:, start:end], window, least)
        if two is None:
            keep = a + lo < b + start
            a, b = a[keep], b[keep]
        yield part[a], second[b + start]


def _pairs_in_cells(cells: DataFrame, window: int, least: int) -> DataFrame:
    """Colliding (a, b), a < b, within rows sorted by (cell, left, right); blocks left <> right meet crosswise."""

    def flush(ids: np.ndarray, sig: np.ndarray, block: np.ndarray, by: int, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
        if left == right:
            met = [(ids[i], ids[j]) for i, j in _windows(sig, None, by, window, least)]
        else:
            one, two = np.flatnonzero(block == left), np.flatnonzero(block == right)
            met = [(ids[one[i]], ids[two[j]]) for i, j in _windows(sig[one], sig[two], by, window, least)] if len(one) and len(two) else []
        x, y = (np.concatenate(v) for v in zip(*met)) if met else (ids[:0], ids[:0])
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        return lo[lo != hi], hi[lo != hi]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if batch.num_columns > 3:
                block, left, right = (batch.column(i).to_numpy() for i in (3, 4, 5))
            else:  # no cell is split
                block = left = right = np.zeros(len(ids), dtype=np.int64)
            key = np.stack([cell, left, right], axis=1)
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.int8).reshape(-1, PROJECTIONS).astype(np.int16)
            if held is not None:
                key, ids, block, sig = (np.concatenate(x) for x in zip(held, (key, ids, block, sig)))
            ends = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            last = ends[-1] if len(ends) else 0
            yield from finish(key[:last], ids[:last], block[:last], sig[:last], ends[:-1])
            held = (key[last:], ids[last:], block[last:], sig[last:])
        if held is not None and len(held[0]):
            yield from finish(*held, np.array([], dtype=np.int64))

    def finish(key, ids, block, sig, ends) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        found = [flush(ids[lo:hi], sig[lo:hi], block[lo:hi], int(key[lo, 0] % PROJECTIONS), key[lo, 1], key[lo, 2]) for lo, hi in zip(np.r_[0, ends], np.r_[ends, len(key)]) if hi - lo > 1]
        if not found:
            return
        a, b = (np.concatenate(x) for x in zip(*found))
        pairs = np.unique(np.stack([a, b], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    by = [c for c in ("cell", "lo", "hi") if c in cells.columns]
    ordered = cells.select("cell", "id", "sig", *[c for c in ("block", "lo", "hi") if c in cells.columns]).repartition(*by).sortWithinPartitions(*by)
    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def _with_blocks(cells: DataFrame) -> DataFrame:
    """Cells over ``HEAVY`` rows become all pairs of hash blocks, so no task holds a whole one."""
    heavy = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY)
    heavy = heavy.select("cell", F.ceil(F.col("n") / HEAVY).cast("bigint").alias("parts"))
    if heavy.isEmpty():
        return cells
    marked = cells.join(heavy, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
    marked = marked.withColumn("block", F.pmod(F.xxhash64("id", "cell"), F.col("parts")))
    meet = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("lo"), F.greatest(j, F.col("block")).alias("hi")))
    return marked.select("cell", "id", "sig", "block", F.inline(meet))


def classes(vectors: DataFrame) -> DataFrame:
    """(chunk_id, class_id, rows): the classes of more than one equal vector; the class is named by its least chunk_id.

    Vectors are told apart by two 64-bit hashes. Counts are pre-aggregated, so a class of a third of
    all rows is no hot key.
    """
    keyed = vectors.select("chunk_id", F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(SEED), "vec").alias("g"))
    several = keyed.groupBy("h", "g").agg(F.min("chunk_id").alias("class_id"), F.count("*").alias("rows")).where("rows > 1")
    several = cut_lineage(several)
    return keyed.join(small_side(several, several.count()), ["h", "g"]).select("chunk_id", "class_id", "rows")


def class_pairs(vectors: DataFrame, members: DataFrame, cosine: float = 0.95, recall: float = RECALL, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b), a < b: pairs of different vectors with at least this cosine, each class by its first row."""
    copies = members.where("chunk_id <> class_id").select("chunk_id")
    single = vectors.join(small_side(copies, copies.count()), "chunk_id", "left_anti")
    sizes = vectors.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).collect()  # one row per vector length
    found = None
    for d, n in ((r["d"], r["n"]) for r in sizes):
        own = single.where(F.size("vec") == d)
        axes = components(d, n / cell_rows)
        radius = WIDTHS * math.sqrt(2 - 2 * cosine) / math.sqrt(d)
        window = math.ceil(radius * GRID * math.sqrt(d) / 2) + 1  # one step for rounding
        cells = _with_blocks(_cells(own, d, axes, table_count(d, cosine, tuple(axes), recall)))
        met = _pairs_in_cells(cells, window, collision_threshold(d))
        found = met if found is None else found.unionByName(met)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "a bigint, b bigint")
    return _verified(cut_lineage(found), vectors, cosine)


def similar_pairs(df: DataFrame, cosine: float = 0.95, recall: float = RECALL, cell_rows: int = CELL_ROWS) -> DataFrame:
    """p4_found: (chunk_id_a, chunk_id_b), a < b, of all usable vectors with at least this cosine.

    Vectors of different lengths are compared among their own only. Classes of up to ``COPIES`` equal
    vectors are written out as all their pairs, among themselves and with others; a larger one, which
    the data do not have, as pairs of its first row with the others and with other classes (so its
    members follow from it). An empty collection gives no rows. Verification is exact; of the true
    pairs the expected share ``recall`` is met in some cell.
    """
    vectors = cut_lineage(usable_vectors(df))
    members = cut_lineage(classes(vectors))
    pairs = class_pairs(vectors, members, cosine, recall, cell_rows)
    few = members.where(F.col("rows") <= COPIES)
    own = few.groupBy("class_id").agg(F.collect_list("chunk_id").alias("ids"))  # at most COPIES each
    n = own.count()
    side = lambda key, ids: small_side(own.select(F.col("class_id").alias(key), F.col("ids").alias(ids)), n, 128)
    every = pairs.join(side("a", "xs"), "a", "left").join(side("b", "ys"), "b", "left")
    every = every.select("a", "b", F.explode(F.coalesce("xs", F.array("a"))).alias("x"), "ys").select("x", F.explode(F.coalesce("ys", F.array("b"))).alias("y"))
    within = own.select(F.explode("ids").alias("x"), "ids").select("x", F.explode("ids").alias("y")).where("x < y")
    large = members.where((F.col("rows") > COPIES) & (F.col("chunk_id") != F.col("class_id"))).select(F.col("class_id").alias("x"), F.col("chunk_id").alias("y"))
    return every.unionByName(within).unionByName(large).select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b"))


def linked_chunks(df: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(chunk_id, class_id, links): every usable vector with the class of its equals and how many others are within the cosine, equals included."""
    vectors = cut_lineage(usable_vectors(df))
    members = cut_lineage(classes(vectors))
    size = members.select("class_id", "rows").distinct()
    pairs = class_pairs(vectors, members, cosine)
    ends = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class_id"), F.col("a").alias("other")))
    met = ends.join(size.select(F.col("class_id").alias("other"), "rows"), "other", "left").groupBy("class_id").agg(F.sum(F.coalesce("rows", F.lit(1))).alias("met"))
    named = vectors.select("chunk_id").join(members, "chunk_id", "left").select("chunk_id", F.coalesce("class_id", "chunk_id").alias("class_id"), F.coalesce("rows", F.lit(1)).alias("rows"))
    return named.join(met, "class_id", "left").select("chunk_id", "class_id", (F.coalesce("met", F.lit(0)) + F.col("rows") - 1).alias("links"))


def _verified(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """The candidate pairs (a, b) whose exact cosine is high enough. Vectors meet the pairs' ends, which are broadcast if few, else shuffled once."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("chunk_id"))
    met = vectors.join(small_side(ends, 2 * pairs.count()), "chunk_id").select("a", "b", "vec")
    both = met.groupBy("a", "b").agg(F.collect_list("vec").alias("v")).where(F.size("v") == 2)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    x, y = F.col("v")[0], F.col("v")[1]
    cos = dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))
    return both.where(cos >= cosine - 1e-9).select("a", "b")


class Search:
    """Top k of a block of queries over batches of rows, by collision counting with virtual rehashing.

    A batch's projections are sorted arrays. Each query's windows start at a radius and grow; only
    what a step adds to a window is counted. Rows that reach the collision threshold are verified
    once. A query is done when its kth best lies within the radius, or the windows hold all rows.
    """

    def __init__(self, queries: np.ndarray, lines: np.ndarray, k: int):
        self.q, self.lines, self.hq = queries, lines, queries @ lines
        self.ids = np.full((len(queries), k), -1, dtype=np.int64)
        self.score = np.full((len(queries), k), -2.0, dtype=np.float32)
        self.least = math.ceil(SEARCH_LEAST * lines.shape[1])
        self.steps = self.counted = self.verified = self.met = 0  # windows grown, rows counted in them, rows verified, query-batches

    def _radius(self) -> np.ndarray:
        """Distance of each query's kth best; without k rows so far, the first radius."""
        far = np.sqrt(np.maximum(0.0, 2 - 2 * self.score[:, -1].astype(np.float64)))
        return np.where(self.ids[:, -1] < 0, FIRST_RADIUS, np.maximum(far, 1e-3))

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        h = rows @ self.lines
        order = np.argsort(h, axis=0, kind="stable").T.copy()
        ranked = np.take_along_axis(h.T, order, axis=1)
        unit, m = SEARCH_WIDTH / math.sqrt(rows.shape[1]), len(order)
        self.met += len(self.q)
        for start in range(0, len(self.q), 512):
            active = np.arange(start, min(len(self.q), start + 512))
            radius = self._radius()[active]
            lo = np.stack([np.searchsorted(ranked[p], self.hq[active, p]) for p in range(m)], axis=1)
            hi, held = lo, [(np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=bool)) for _ in active]
            while len(active):
                width = radius * unit
                a = np.stack([np.searchsorted(ranked[p], self.hq[active, p] - width, "left") for p in range(m)], axis=1)
                b = np.stack([np.searchsorted(ranked[p], self.hq[active, p] + width, "right") for p in range(m)], axis=1)
                a, b = np.minimum(a, lo), np.maximum(b, hi)
                for n, i in enumerate(active):
                    self._count(i, ids, rows, order, (a[n], lo[n], hi[n], b[n]), *held[n])
                within = (self.ids[active, -1] >= 0) & (self._radius()[active] <= radius)
                on = ~(within | ((b - a).min(axis=1) == len(rows)))
                self.steps += len(active)
                active, radius, lo, hi, held = active[on], radius[on] * GROWTH, a[on], b[on], [x for x, keep in zip(held, on) if keep]

    def _count(self, i: int, ids: np.ndarray, rows: np.ndarray, order: np.ndarray, ends: tuple, count: np.ndarray, done: np.ndarray) -> None:
        """Counts what the query's windows (a to b) take in beyond the former ones (lo to hi), and verifies what has enough collisions now."""
        fresh = [part for p, (a, lo, hi, b) in enumerate(zip(*ends)) for part in (order[p, a:lo], order[p, hi:b]) if len(part)]
        if not fresh:
            return
        fresh = np.concatenate(fresh)
        self.counted += len(fresh)
        count += np.bincount(fresh, minlength=len(rows))
        met = np.flatnonzero((count >= self.least) & ~done)
        if len(met):
            done[met] = True
            self.verified += len(met)
            self._merge(i, ids[met], rows[met] @ self.q[i])

    def _merge(self, i: int, ids: np.ndarray, score: np.ndarray) -> None:
        k = self.ids.shape[1]
        keep = score >= self.score[i, -1]
        ids, score = np.concatenate([self.ids[i], ids[keep]]), np.concatenate([self.score[i], score[keep]])
        top = np.lexsort((ids, -score))[:k]
        self.ids[i], self.score[i] = ids[top], score[top]


def _batches(batches: Iterator[pa.RecordBatch], dim: int, rows: int = 16384) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) in batches of at least ``rows``, so that a query's windows are looked up in few arrays."""
    ids, vecs, n = [], [], 0
    for batch in batches:
        if batch.num_rows:
            ids.append(batch.column(0).to_numpy())
            vecs.append(unit_rows(batch.column(1), dim))
            n += batch.num_rows
        if n >= rows:
            yield np.concatenate(ids), np.concatenate(vecs)
            ids, vecs, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(vecs)


def nearest(df: DataFrame, k: int = 10, every: int = 100, exact: bool = False) -> DataFrame:
    """(chunk_id, rank, neighbour_id, cosine): the k most similar usable vectors of each query.

    Queries are the usable vectors whose chunk_id is divisible by ``every`` (1: all of them),
    searched in blocks of ``QUERY_BLOCK`` rows against all usable vectors; a vector is not its own
    neighbour; ties go by the smaller id. Fewer than k others give fewer rows. With ``exact`` every row
    is verified, which is what recall is measured against.
    """
    vectors = cut_lineage(usable_vectors(df))
    first = vectors.select(F.size("vec").alias("d")).groupBy("d").count().orderBy(F.desc("count")).limit(1).collect()
    out = "chunk_id bigint, neighbour_id bigint, cosine double"
    if not first:
        return df.sparkSession.createDataFrame([], "chunk_id bigint, rank int, neighbour_id bigint, cosine double")
    dim = first[0]["d"]
    vectors = vectors.where(F.size("vec") == dim)
    lines = directions(dim, SEARCH_PROJECTIONS, SEED + 2)
    asked = vectors.where(F.pmod("chunk_id", F.lit(every)) == 0)
    n_asked = asked.count()
    blocks = max(1, -(-n_asked // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        # One block is of bounded size: QUERY_BLOCK vectors on average.
        rows = asked.where(F.col("block") == block).select("chunk_id", "vec").toArrow()
        if not rows.num_rows:
            continue
        rows = rows.combine_chunks()
        ids = rows.column("chunk_id").to_numpy()
        queries = df.sparkSession.sparkContext.broadcast((ids, unit_rows(rows.column("vec").combine_chunks(), dim)))

        def run(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            qid, q = queries.value
            search = Search(q, lines, k + 1)
            for ids, rows in _batches(batches, dim):
                if exact:
                    for i, score in enumerate(q @ rows.T):
                        search._merge(i, ids, score)
                else:
                    search.add(ids, rows)
            i, j = np.nonzero((search.score > -1.5) & (search.ids != qid[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(search.ids[i, j]), pa.array(search.score[i, j].astype(np.float64))], ["chunk_id", "neighbour_id", "cosine"])

        part = vectors.select("chunk_id", "vec").mapInArrow(run, out)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.sparkSession.createDataFrame([], "chunk_id bigint, rank int, neighbour_id bigint, cosine double")
    w = Window.partitionBy("chunk_id").orderBy(F.desc("cosine"), "neighbour_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("chunk_id", F.col("rank").cast("int").alias("rank"), "neighbour_id", F.round("cosine", 6).alias("cosine"))


def search_recall(df: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(queries, wanted, found, recall): the search's k nearest against those of verifying every row, over the stated queries."""
    want, got = (nearest(df, k, every, exact).select("chunk_id", "neighbour_id") for exact in (True, False))
    hit = want.join(got.withColumn("hit", F.lit(1)), ["chunk_id", "neighbour_id"], "left")
    return hit.agg(F.count_distinct("chunk_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.round(F.try_divide("found", "wanted"), 4))
