"""Hard negatives: per anchor its nearest positives, per positive the best negatives inside a score window.

Scores are inner products of integer vectors.  Anchors and candidates are dealt
into blocks of a bounded number of components; a cell is one block of anchors
against one block of candidates.  In a cell, tiles of both are multiplied by
Strassen's recursion on int64 (odd sizes padded with zeros, all additions
exact), and bounded heaps keep what is best so far.  Cells give one heap per
anchor (or per anchor and positive), and heaps of all cells are merged by a
ranking limited to the heap's size, so no task sees all candidates.

Two passes: the window of a positive is known only when the positives of all
cells are merged.  Ties go to the smaller vec_id, then to the row stored first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiccases.llm.common import python_workers, saved
from civiccases.llm.vectors import NO_ID, block_of, block_rows, extent, matrix, numbers, whole_vectors

POSITIVES = 5
NEGATIVES = 10
#: the window: LOW * positive <= 100 * negative <= HIGH * positive
LOW, HIGH = 30, 90
#: rows of a tile of anchors and of candidates; sides up to LEAF are multiplied directly
TILE_ANCHORS, TILE_CANDIDATES, LEAF = 256, 1024, 16
LEAST = np.int64(-2 ** 63)


# --- multiplication ------------------------------------------------------------------------

def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b for int64 by seven products of halves; exact whenever the result fits (sums wrap modulo 2^64)."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ b
    a = np.pad(a, ((0, rows % 2), (0, inner % 2))) if rows % 2 or inner % 2 else a
    b = np.pad(b, ((0, inner % 2), (0, columns % 2))) if inner % 2 or columns % 2 else b
    r, k, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :k], a[:r, k:], a[r:, :k], a[r:, k:]
    b11, b12, b21, b22 = b[:k, :c], b[:k, c:], b[k:, :c], b[k:, c:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * r, 2 * c), np.int64)
    out[:r, :c] = m1 + m4 - m5 + m7
    out[:r, c:] = m3 + m5
    out[r:, :c] = m2 + m4
    out[r:, c:] = m1 - m2 + m3 + m6
    return out[:rows, :columns]


# --- heaps ---------------------------------------------------------------------------------

class Heaps:
    """Bounded heaps of (score, -position), one per key; candidates come in ascending position."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.floor = np.full(n, LEAST)  # a later candidate must exceed its heap's least score

    def add(self, first: int, scores: np.ndarray, allowed: np.ndarray, at: int) -> None:
        """A tile of scores for the keys from ``first`` on; candidates have the positions from ``at`` on."""
        last = first + len(scores)
        floor = self.floor[first:last]
        if scores.shape[1] > 4 * self.size and (floor == LEAST).any():  # what the tile itself pushes out again stays out
            least = np.partition(np.where(allowed, scores, LEAST), -self.size, axis=1)[:, -self.size]
            floor = np.maximum(floor, np.where(least > LEAST, least - 1, LEAST))
        rows, columns = np.nonzero(allowed & (scores > floor[:, None]))
        for r, c, s in zip(rows.tolist(), columns.tolist(), scores[rows, columns].tolist(), strict=True):
            heap = self.heaps[first + r]
            if len(heap) < self.size:
                heapq.heappush(heap, (s, -at - c))
            elif s > heap[0][0]:
                heapq.heapreplace(heap, (s, -at - c))
        for r in np.unique(rows).tolist():
            if len(self.heaps[first + r]) == self.size:
                self.floor[first + r] = self.heaps[first + r][0][0]

    def entries(self) -> Iterable[tuple[int, int, int]]:
        """(key, score, position), best first within a key."""
        for key, heap in enumerate(self.heaps):
            for score, minus in sorted(heap, reverse=True):
                yield key, score, -minus


class Cell:
    """The candidates of a block in (vec_id, row) order, and its tiles of scores."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table, dim: int):
        self.anchors = matrix(anchors["v"], dim)
        self.anchor_label, self.anchor_row = numbers(anchors["label"]), numbers(anchors["row"])
        ids, rows = numbers(candidates["vec_id"]), numbers(candidates["row"])
        order = np.lexsort((rows, ids))
        self.vec_id, self.row = ids[order], rows[order]
        self.label = numbers(candidates["label"])[order]
        self.candidates = matrix(candidates["v"], dim)[order]

    def tiles(self) -> Iterable[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(first anchor, end, first candidate, scores, whether labels are the same); candidates ascend for each anchor."""
        for i in range(0, len(self.anchors), TILE_ANCHORS):
            end = min(i + TILE_ANCHORS, len(self.anchors))
            for j in range(0, len(self.candidates), TILE_CANDIDATES):
                piece = slice(j, j + TILE_CANDIDATES)
                yield (i, end, j, strassen(self.anchors[i:end], self.candidates[piece].T),
                       self.anchor_label[i:end, None] == self.label[piece])


def _table(columns: dict[str, tuple[Iterable, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array(list(values), kind) for name, (values, kind) in columns.items()})


def _positives(dim: int, size: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and candidates.num_rows:
            cell = Cell(anchors, candidates, dim)
            heaps = Heaps(len(cell.anchors), size)
            for i, end, j, scores, same in cell.tiles():
                other = cell.anchor_row[i:end, None] != cell.row[j:j + TILE_CANDIDATES]
                heaps.add(i, scores, same & other, j)
            found = [(cell.anchor_row[k], cell.row[p], cell.vec_id[p], s) for k, s, p in heaps.entries()]
        a, r, i, s = zip(*found, strict=True) if found else ((), (), (), ())
        return _table({"anchor": (a, pa.int64()), "row": (r, pa.int64()), "vec_id": (i, pa.int64()), "score": (s, pa.int64())})
    return run


def _negatives(dim: int, size: int, low: int, high: int):
    """Anchors carry ``positives``: the scores of their positives, best first."""
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and candidates.num_rows:
            cell = Cell(anchors, candidates, dim)
            scores_of = anchors["positives"].to_pylist()
            slots = max(map(len, scores_of))
            positive = np.array([s + [0] * (slots - len(s)) for s in scores_of], np.int64)
            given = np.arange(slots) < np.array([len(s) for s in scores_of])[:, None]
            heaps = [Heaps(len(cell.anchors), size) for _ in range(slots)]
            for i, end, j, scores, same in cell.tiles():
                hundred = 100 * scores
                for slot in range(slots):
                    p = positive[i:end, slot, None]
                    allowed = ~same & given[i:end, slot, None] & (low * p <= hundred) & (hundred <= high * p)
                    heaps[slot].add(i, scores, allowed, j)
            found = [(cell.anchor_row[k], slot + 1, cell.row[p], cell.vec_id[p], s)
                     for slot in range(slots) for k, s, p in heaps[slot].entries()]
        a, t, r, i, s = zip(*found, strict=True) if found else ((), (), (), (), ())
        return _table({"anchor": (a, pa.int64()), "slot": (t, pa.int32()), "row": (r, pa.int64()),
                       "vec_id": (i, pa.int64()), "score": (s, pa.int64())})
    return run


# --- the operator --------------------------------------------------------------------------

def _copied(rows: DataFrame, copies: int, own: str, other: str) -> DataFrame:
    """Each row once for every block of the other side."""
    return rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long")))).select(
        F.struct(F.col("a"), F.col("c")).alias("cell"), *[x for x in rows.columns if x != own])


def _best(found: DataFrame, size: int, *keys: str) -> DataFrame:
    """Merged heaps: the ``size`` first of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors: rows whose vec_id ``every`` divides.  ``embeddings`` has vec_id,
    embedding and label.  Rows with a null label, a null vector or a null or
    non-finite component take no part; a row without vec_id does, as a candidate
    that is last among ties and has a null id in the result.  Shorter vectors
    are padded with zeros.  Rows that repeat a vec_id are rows of their own: an
    anchor's other rows are all rows but itself.  Anchors without positives, or
    without rows in the window, give nothing.  Extra columns are ignored; an
    empty table gives an empty result.  Scores that may not fit into 64 bits
    raise an ArithmeticError.
    """
    spark = embeddings.sparkSession
    python_workers(spark)
    vectors = whole_vectors(embeddings.where("label is not null"), scale, F.col("label").cast("long").alias("label"))
    n, dim = extent(vectors, 100)
    chosen = F.col("vec_id") != NO_ID
    anchors = vectors.where(chosen & (F.col("vec_id") % every == 0))
    size = block_rows(dim)
    n_anchors = anchors.count()
    blocks_a, blocks_c = max(1, -(-n_anchors // size)), max(1, -(-n // size))
    anchors = anchors.withColumn("a", block_of(F.col("row"), blocks_a))
    candidates = _copied(vectors.withColumn("c", block_of(F.col("row"), blocks_c)), blocks_a, "c", "a").groupBy("cell")

    near = (_copied(anchors, blocks_c, "a", "c").groupBy("cell").cogroup(candidates)
            .applyInArrow(_positives(dim, positives), "anchor long, row long, vec_id long, score long"))
    near = saved(_best(near, positives, "anchor"), "positives")
    windows = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("found")).select(
        F.col("anchor").alias("row"), F.col("found.score").alias("positives"))
    known = saved(anchors.join(windows, "row"), "anchors")
    hard = (_copied(known, blocks_c, "a", "c").groupBy("cell").cogroup(candidates)
            .applyInArrow(_negatives(dim, negatives, low, high), "anchor long, slot int, row long, vec_id long, score long"))
    hard = _best(hard, negatives, "anchor", "slot").select(
        "anchor", "slot", F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = known.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (hard.join(near.select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"),
                                  F.col("score").alias("positive_score")), ["anchor", "slot"])
            .join(names, "anchor").select(
        "anchor_id", F.nullif("positive_id", F.lit(NO_ID)).alias("positive_id"), "rank",
        F.nullif("negative_id", F.lit(NO_ID)).alias("negative_id"), "positive_score", "negative_score"))
