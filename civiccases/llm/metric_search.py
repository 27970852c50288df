"""Exact top-k search by inner product with an M-tree of paged metric nodes.

Index.  Rows are assigned to the nearest of a bounded sample of routing rows
(regions); a region is cut into blocks of a bounded number of components, so a
region with a third of all rows is many blocks.  Each block is bulk-loaded into
an M-tree of pages: a page has a routing row, and per entry the distance to it
(the parent distance); entries of inner pages lead to a page and have a covering
radius and the largest norm below.  The pages are a table, one row a page.

Search.  For a query q and any x: <q,x> = (|q|^2 + |x|^2 - d(q,x)^2) / 2, so a
lower bound of the distance is an upper bound of the score.  With the distance
d(q,o) to the routing row known, |d(q,o) - parent distance| bounds the distance
to an entry without computing it; covering radii do so for whole pages.  Pages
are visited best bound first until no bound reaches the k-th score found.

Two rounds: every query first searches the block with the best bound; all other
blocks whose bound reaches its k-th score follow, each starting from that score.
Heaps of all blocks are merged by a ranking limited to k.  Scores are exact
integers; bounds are doubles, widened by far more than their rounding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiccases.llm.common import python_workers, saved
from civiccases.llm.vectors import NO_ID, block_rows, extent, matrix, numbers, whole_vectors

TOP = 10
SCALE = 1024
#: entries of a page
PAGE = 128
#: routing rows at the root: at most this sample, by the order of a hash of the row number
REGIONS = 64
#: queries that are searched together in a block
QUERIES = 4096
#: widens a bound, relative to the sizes that went into it
SLACK = 1e-9


def squares(v: np.ndarray) -> np.ndarray:
    f = v.astype(np.float64)
    return np.einsum("...i,...i->...", f, f)


def distances(v: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Euclidean distances of integer rows to one row."""
    return np.sqrt(squares(v.astype(np.float64) - o.astype(np.float64)))


def bound(q2: float, most: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The largest score of rows with squared norm up to ``most`` that are at least ``distance`` from q.

    A score is at most |q| |x| too; both bounds are widened by ``SLACK``.
    """
    by_distance = (q2 + most - np.maximum(distance, 0.0) ** 2) / 2
    return np.minimum(by_distance, np.sqrt(q2 * most)) + SLACK * (q2 + most + distance ** 2) + 1e-6


# --- the tree of a block -------------------------------------------------------------------

@dataclass
class Page:
    """Entries of a page; ``child`` is -1 in a leaf, where radii are 0 and ``most`` are the rows' own squared norms."""
    routing: int          # position of the page's routing row
    entry: np.ndarray     # positions of the entries' rows
    child: np.ndarray
    parent_distance: np.ndarray
    radius: np.ndarray
    most: np.ndarray


def build_pages(v: np.ndarray, page: int = PAGE) -> list[Page]:
    """The M-tree of the rows of ``v``, bulk-loaded; the root is the last page."""
    norms, pages = squares(v), []

    def load(routing: int, at: np.ndarray) -> int:
        if len(at) <= page:
            pages.append(Page(routing, at, np.full(len(at), -1), distances(v[at], v[routing]), np.zeros(len(at)), norms[at]))
            return len(pages) - 1
        seeds = at[np.linspace(0, len(at) - 1, min(page, -(-len(at) // page) + 1)).astype(np.int64)]
        f = v[at].astype(np.float64)
        centres = v[seeds].astype(np.float64)
        nearest = np.argmin(squares(centres)[None, :] - 2 * f @ centres.T, axis=1)
        counts = np.bincount(nearest, minlength=len(seeds))
        if counts.max() == len(at):  # all rows alike
            nearest = np.arange(len(at)) * len(seeds) // len(at)
        entry, child, radius, most = [], [], [], []
        for s, seed in enumerate(seeds):
            own = at[nearest == s]
            if len(own):
                child.append(load(int(seed), own))
                entry.append(int(seed))
                radius.append(distances(v[own], v[seed]).max())
                most.append(norms[own].max())
        entry = np.array(entry)
        pages.append(Page(routing, entry, np.array(child), distances(v[entry], v[routing]), np.array(radius), np.array(most)))
        return len(pages) - 1

    if len(v):
        load(0, np.arange(len(v)))
    return pages


def search_pages(v: np.ndarray, vec_id: np.ndarray, row: np.ndarray, pages: list[Page], q: np.ndarray, own: int,
                 top: int, reach: int | None) -> tuple[list[tuple[int, int]], int]:
    """(the ``top`` best (score, position), scores computed); scores below ``reach`` need not be found.

    Best first: the page with the largest bound is next, and the search ends
    when that is below the k-th score so far.  Ties go to the smaller (vec_id, row).
    """
    heap: list[tuple[int, int, int, int]] = []  # (score, -vec_id, -row, position): the worst is first
    q2, qf, computed = float(squares(q)), q.astype(np.float64), 0
    least = -np.inf if reach is None else float(reach)
    root = pages[-1]
    queue = [(-np.inf, len(pages) - 1, float(distances(v[root.routing], qf)))]
    while queue:
        minus, number, d_routing = heapq.heappop(queue)
        if -minus < least:
            break
        p = pages[number]
        apart = np.abs(d_routing - p.parent_distance) - p.radius  # a lower bound, nothing computed
        near = np.flatnonzero(bound(q2, p.most, apart) >= least)
        at = p.entry[near]
        computed += len(at)
        if p.child[0] < 0:
            scores = v[at] @ q
            for i in np.flatnonzero(scores >= least).tolist():
                x = int(at[i])
                found = (int(scores[i]), -int(vec_id[x]), -int(row[x]), x)
                if row[x] == own:
                    continue
                if len(heap) < top:
                    heapq.heappush(heap, found)
                elif found > heap[0]:
                    heapq.heapreplace(heap, found)
            if len(heap) == top:
                least = max(least, float(heap[0][0]))
        else:
            d = distances(v[at], qf)
            for i, high, far in zip(near.tolist(), bound(q2, p.most[near], d - p.radius[near]).tolist(), d.tolist(), strict=True):
                if high >= least:
                    heapq.heappush(queue, (-high, int(p.child[i]), far))  # the entry is its page's routing row
    return [(s, x) for s, _, _, x in sorted(heap, reverse=True)], computed


# --- Arrow -----------------------------------------------------------------------------------

PAGES_SCHEMA = ("block long, page int, routing int, entry array<int>, child array<int>, parent_distance array<double>, "
                "radius array<double>, most array<double>, row array<long>, vec_id array<long>, v array<array<long>>")


def _load_block(page: int, dim: int):
    """A block's rows as its pages; a leaf carries its rows."""
    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(numbers(rows["row"]), kind="stable")
        v, row, vec_id = matrix(rows["v"], dim)[order], numbers(rows["row"])[order], numbers(rows["vec_id"])[order]
        out = []
        for k, p in enumerate(build_pages(v, page)):
            leaf = p.child[0] < 0
            out.append({"block": rows["block"][0].as_py(), "page": k, "routing": p.routing, "entry": p.entry.tolist(),
                        "child": p.child.tolist(), "parent_distance": p.parent_distance.tolist(), "radius": p.radius.tolist(),
                        "most": p.most.tolist(), "row": row[p.entry].tolist() if leaf else [],
                        "vec_id": vec_id[p.entry].tolist() if leaf else [], "v": v[p.entry].tolist() if leaf else []})
        return pa.Table.from_pylist(out, schema=pa.schema([
            ("block", pa.int64()), ("page", pa.int32()), ("routing", pa.int32()), ("entry", pa.list_(pa.int32())),
            ("child", pa.list_(pa.int32())), ("parent_distance", pa.list_(pa.float64())), ("radius", pa.list_(pa.float64())),
            ("most", pa.list_(pa.float64())), ("row", pa.list_(pa.int64())), ("vec_id", pa.list_(pa.int64())),
            ("v", pa.list_(pa.list_(pa.int64())))]))
    return run


def _read_block(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Page]]:
    """(vectors, vec_ids, row numbers) by position, and the pages in order."""
    table = table.sort_by("page")
    pages = [Page(r["routing"], np.array(r["entry"], np.int64), np.array(r["child"], np.int64), np.array(r["parent_distance"]),
                  np.array(r["radius"]), np.array(r["most"]))
             for r in table.select(["routing", "entry", "child", "parent_distance", "radius", "most"]).to_pylist()]
    leaves = [p.entry for p in pages if p.child[0] < 0]
    at = np.concatenate(leaves)
    flat = table["v"].combine_chunks().flatten()
    v, vec_id, row = np.empty((len(at), dim), np.int64), np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    v[at] = matrix(flat, dim)
    vec_id[at] = table["vec_id"].combine_chunks().flatten().to_numpy()
    row[at] = table["row"].combine_chunks().flatten().to_numpy()
    return v, vec_id, row, pages


def _search_block(top: int, dim: int):
    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        found, ids, rows = [], None, None
        if block.num_rows and queries.num_rows:
            v, ids, rows, pages = _read_block(block, dim)
            for q, own, reach in zip(matrix(queries["v"], dim), queries["row"].to_pylist(), queries["reach"].to_pylist(), strict=True):
                best, _ = search_pages(v, ids, rows, pages, q, own, top, reach)
                found += [(own, int(rows[x]), int(ids[x]), s) for s, x in best]
        q, r, i, s = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.table({"query": pa.array(q, pa.int64()), "row": pa.array(r, pa.int64()),
                         "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})
    return run


def _assign(centres: np.ndarray, dim: int):
    """Adds the nearest routing row and the distance to it."""
    f = centres.astype(np.float64)
    sizes = squares(f)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            v = matrix(batch.column("v"), dim)
            region = np.argmin(sizes[None, :] - 2 * v.astype(np.float64) @ f.T, axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(region.astype(np.int64)), pa.array(np.sqrt(squares(v - centres[region]))),
                 pa.array(squares(v))], names=[*batch.schema.names, "region", "far", "norm"])
    return run


def _bounds(centres: np.ndarray, radius: np.ndarray, most: np.ndarray, dim: int):
    """(row, bounds): the bound of each region, for every query."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            q = matrix(batch.column("v"), dim)
            q2 = squares(q)[:, None]
            apart = np.stack([distances(q, c) for c in centres], axis=1) - radius
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(list(bound(q2, most[None, :], apart)), pa.list_(pa.float64()))], names=["row", "bounds"])
    return run


# --- the operator ----------------------------------------------------------------------------

class Index:
    """Pages of all blocks, and the root: routing rows, covering radii, largest norms, blocks of each region.

    The root has at most ``REGIONS`` entries, whatever the data.
    """

    def __init__(self, vectors: DataFrame, n: int, dim: int, page: int = PAGE, regions: int = REGIONS, size: int | None = None):
        self.dim, size = dim, size or block_rows(dim)
        wanted = min(regions, max(1, -(-n // size)))
        sample = vectors.select(F.xxhash64("row").alias("_h"), "row", "v").orderBy("_h", "row").limit(wanted).collect()
        centres = np.zeros((len(sample), dim), np.int64)
        for i, r in enumerate(sample):
            centres[i, :len(r["v"])] = r["v"]
        placed = saved(vectors.mapInArrow(
            _assign(centres, dim), "vec_id long, v array<long>, row long, region long, far double, norm double"), "placed")
        stats = {r["region"]: r for r in placed.groupBy("region").agg(
            F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.max("norm").alias("most")).collect()}
        self.regions = sorted(stats)
        self.centres = centres[self.regions]
        self.radius = np.array([stats[k]["radius"] for k in self.regions])
        self.most = np.array([stats[k]["most"] for k in self.regions])
        self.blocks = [-(-stats[k]["n"] // size) for k in self.regions]
        self.first = np.concatenate(([0], np.cumsum(self.blocks)))[:-1].tolist()  # number of a region's first block
        number = F.create_map(*[F.lit(x) for k, r in enumerate(self.regions) for x in (r, k)])[F.col("region")]
        block = F.get(F.lit(self.first), number) + F.pmod(F.xxhash64("row"), F.get(F.lit(self.blocks), number))
        self.pages = saved(placed.select(block.cast("long").alias("block"), "row", "vec_id", "v").groupBy("block")
                           .applyInArrow(_load_block(page, dim), PAGES_SCHEMA), "pages")

    def targets(self, queries: DataFrame) -> DataFrame:
        """(row, at): the regions of each query, best bound first, as (bound, first block, number of blocks)."""
        bounds = queries.select("row", "v").mapInArrow(
            _bounds(self.centres, self.radius, self.most, self.dim), "row long, bounds array<double>")
        first, blocks = F.lit(self.first), F.lit(self.blocks)
        return bounds.select("row", F.sort_array(F.transform("bounds", lambda b, k: F.struct(
            b.alias("bound"), F.get(first, k).cast("long").alias("first"), F.get(blocks, k).cast("long").alias("blocks"))),
            asc=False).alias("at"))

    def search(self, visits: DataFrame, top: int, spread: int) -> DataFrame:
        """(query, row, vec_id, score) of visits (block, row, v, reach); ``spread`` chunks of queries a block."""
        visits = saved(visits.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(spread))), "visits")
        cells = visits.select(F.col("block").alias("of"), F.struct("block", "chunk").alias("cell")).distinct()
        pages = self.pages.join(cells, self.pages["block"] == cells["of"]).drop("of")
        return (pages.groupBy("cell").cogroup(visits.groupBy(F.struct("block", "chunk").alias("cell")))
                .applyInArrow(_search_block(top, self.dim), "query long, row long, vec_id long, score long"))


def top_k(embeddings: DataFrame, every: int = 100, top: int = TOP, scale: int = SCALE, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` rows of largest integer inner product for each query.

    Queries: rows whose vec_id ``every`` divides; candidates: every row but the
    query's own; ties to the smaller vec_id.  Null vectors and vectors with null
    or non-finite components take no part.  Shorter vectors are padded with
    zeros.  A row without vec_id is a candidate that is last among ties and has
    a null id in the result.  Rows that repeat a vec_id are rows of their own:
    each is a query, and a candidate of the others.  Extra columns are ignored;
    an empty table gives an empty result.  Scores that may not fit into 64 bits
    raise an ArithmeticError.  ``block`` is the number of rows of a block (by
    default as many as ``BLOCK_VALUES`` components).
    """
    spark = embeddings.sparkSession
    python_workers(spark)
    vectors = whole_vectors(embeddings, scale)
    n, dim = extent(vectors, 1)
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    chosen = F.col("vec_id") != NO_ID
    queries = saved(vectors.where(chosen & (F.col("vec_id") % every == 0)).select("row", F.col("vec_id").alias("query_id"), "v"), "queries")
    spread = max(1, -(-queries.count() // QUERIES))
    index = Index(vectors, n, dim, size=block)
    at = saved(index.targets(queries), "targets")
    best = F.get("at", F.lit(0))
    at = at.withColumn("start", best["first"] + F.pmod(F.xxhash64("row"), best["blocks"]))
    found = saved(index.search(at.join(queries, "row").select(
        F.col("start").alias("block"), "row", "v", F.lit(None).cast("long").alias("reach")), top, spread), "first")
    reach = found.groupBy(F.col("query").alias("row")).agg(
        F.when(F.count(F.lit(1)) == top, F.min("score")).alias("reach"))
    later = (at.join(reach, "row", "left").select("row", "reach", "start", F.explode("at").alias("t"))
             .where(F.col("reach").isNull() | (F.col("t.bound") >= F.col("reach")))
             .select("row", "reach", "start", F.explode(F.sequence("t.first", F.col("t.first") + F.col("t.blocks") - 1)).alias("block"))
             .where("block != start").join(queries, "row").select("block", "row", "v", "reach"))
    found = found.unionByName(index.search(later, top, spread))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("row")
    return (best.join(queries.select(F.col("row").alias("query"), "query_id"), "query")
            .select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score"))
