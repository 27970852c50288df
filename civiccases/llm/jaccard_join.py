"""Exact Jaccard join on word n-gram sets by T-occurrence search; result: components.

Two documents link when their sets of distinct 5-word shingles have a Jaccard
similarity of ``threshold`` or more.  Steps:

1. Equal sets are one class, represented by its smallest doc_id; copies are
   never compared with each other.
2. Each set is ordered by a global order, rare shingles first.  A pair with
   overlap >= T shares a shingle among the first ``n - T + 1`` of either
   set (n - ceil(threshold * n) + 1 here), so only these go to the inverted
   lists: one shuffle of rows (shingle, doc).  Lists of one document end there.
3. Candidates are verified by a T-occurrence search: a query document against a
   block of candidates, with the inverted lists of the block.  DivideSkip: the
   longest lists are set aside, the short ones are merged with a heap that skips
   candidates which cannot reach T - L, the long ones are probed by binary search.
   Before that, pairs that share too few lists to reach T are dropped.
4. A list of n documents is not expanded to n * n pairs.  First each document
   meets the first and the last document of its lists, then the one that is in
   the most lists; linked documents get a common label.  Only pairs of different
   labels are expanded after that.  A pair that must share c lists meets in the
   shortest ones: the c - 1 longest lists of either document are skipped.  A pair
   that is left out lies within a label, so no component changes.
5. Components by repeated minimum labels with pointer jumping.

Shingles are 64-bit hashes.  A class of a third of all rows is one row after
step 1; a query with many candidates is dealt out in salted blocks of bounded
size (the query is repeated for each); nothing is capped.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiccases.llm.common import saved, python_workers

WIDTH = 5
#: link when 100 * overlap >= PERCENT * union
PERCENT = 80
#: candidates of one query searched together
BLOCK = 256
#: shingles whose frequency the global order knows; others count as rare.  Any order is correct.
ORDERED_SHINGLES = 100_000
#: shingles counted together in a task, and the count there that makes one a candidate for the order
COUNT_CHUNK, COUNT_LEAST = 2_000_000, 3

_ODD = np.random.default_rng(5).integers(1, 2 ** 63, 64, dtype=np.uint64) | np.uint64(1)


# --- sets --------------------------------------------------------------------------

def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    mixed = np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        mixed += h[k:len(words) - span + 1 + k] * _ODD[k]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Overlap that a set of n needs with any partner, whatever the partner's size."""
    return -(-percent * n // 100)


def _common_batches(batches: Iterator[pa.RecordBatch], width: int):
    """(shingle, documents) of shingles that occur more than once in a chunk of whole documents."""
    held, size = [], 0

    def counted():
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= COUNT_LEAST
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["token", "n"])

    for batch in batches:
        for text in batch.column(0):
            held.append(shingle_set(text.as_py(), width))
            size += len(held[-1])
            if size >= COUNT_CHUNK:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def common_shingles(docs: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles over all documents (sorted by hash) and their counts, at most ORDERED_SHINGLES."""
    rows = (docs.select("text").mapInArrow(lambda b: _common_batches(b, width), "token long, n long")
            .groupBy("token").agg(F.sum("n").alias("n")).where("n >= 8")
            .orderBy(F.desc("n"), "token").limit(ORDERED_SHINGLES).toPandas())
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows["n"].to_numpy(np.int64)[order]


def rarest_first(tokens: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set in the global order: by known frequency, then by hash."""
    known, counts = common
    if not len(known) or not len(tokens):
        return tokens
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    n = np.where(known[at] == tokens, counts[at], 0)
    return tokens[np.lexsort((tokens, n))] if n.any() else tokens


def _prefix_batches(batches: Iterator[pa.RecordBatch], common, width: int, percent: int):
    for batch in batches:
        sizes, keys, prefixes = [], [], []
        for text in batch.column(1):
            tokens = shingle_set(text.as_py(), width)
            n = len(tokens)
            sizes.append(n)
            keys.append(xxhash.xxh3_128_digest(tokens.tobytes()) if n else None)
            prefixes.append(rarest_first(tokens, common)[:n - least_overlap(n, percent) + 1 if n else 0]
                            .view(np.int64))
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
        flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            names=["doc_id", "n", "set_key", "prefix"])


# --- T-occurrence search -------------------------------------------------------------

def t_occurrence(lists: list[list[int]], needed: dict[int, int], skew: float = 0.02) -> dict[int, int]:
    """Candidates that occur in at least ``needed[candidate]`` of the sorted lists, with their counts.

    DivideSkip: L = T / (skew * log2(longest) + 1) long lists are set aside (T:
    the least number needed); the heap over the short ones yields candidates in
    order, and lists whose head cannot reach T - L jump ahead by binary search.
    """
    found: dict[int, int] = {}
    lists = sorted((x for x in lists if x), key=len)
    if not lists or not needed:
        return found
    t = min(needed.values())
    aside = min(len(lists), int(t / (skew * np.log2(len(lists[-1]) + 1) + 1)), t - 1)
    short, long = lists[:len(lists) - aside], lists[len(lists) - aside:]
    enough = t - aside
    heap = [(x[0], k, 0) for k, x in enumerate(short)]
    heapq.heapify(heap)
    while heap:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= enough:
            count = len(popped)
            # long lists hold the rest: probe them while the need can still be met
            for i, x in enumerate(long):
                if count + len(long) - i < needed[top]:
                    break
                at = bisect_left(x, top)
                count += at < len(x) and x[at] == top
            else:
                if count >= needed[top]:
                    found[top] = count
            target = top + 1
        else:
            # fewer heads than needed: drop heads until `enough` lists are out, and go on from the next
            while heap and len(popped) < enough - 1:
                popped.append(heapq.heappop(heap))
            target = max(heap[0][0], top + 1) if heap else None
        if target is None:
            break
        for _, k, at in popped:
            at = bisect_left(short[k], target, at)
            if at < len(short[k]):
                heapq.heappush(heap, (short[k][at], k, at))
    return found


def search_block(query: np.ndarray, candidates: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Indexes of the candidate sets that link with the query set."""
    n = len(query)
    needed = {}
    tokens, owners = [], []
    for k, c in enumerate(candidates):
        # overlap * 100 >= percent * (n + m - overlap)
        need = max(1, -(-percent * (n + len(c)) // (100 + percent)))
        if min(n, len(c)) < need:
            continue
        needed[k] = need
        at = np.searchsorted(query, c)
        at[at == n] = 0
        hit = at[query[at] == c]
        tokens.append(hit)
        owners.append(np.full(len(hit), k))
    if not needed:
        return []
    token, owner = np.concatenate(tokens), np.concatenate(owners)
    order = np.argsort(token, kind="stable")  # owners ascend within a token
    token, owner = token[order], owner[order]
    cuts = np.flatnonzero(np.diff(token)) + 1
    lists = [x.tolist() for x in np.split(owner, cuts)] if len(token) else []
    return sorted(t_occurrence(lists, needed))


def _search_batches(batches: Iterator[pa.RecordBatch], width: int, percent: int):
    """Rows (a, salt, b, text) sorted by (a, salt), the query row (b null) first in its group."""
    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    out: list[tuple[int, int]] = []

    def send():
        a, b = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for (a, _), group in groupby(rows(), key=lambda r: (r[0], r[1])):
        queries, block = [], []

        def search(block, queries, a=a):
            sets = [s for _, s in block]
            for q in queries:
                out.extend((a, block[i][0]) for i in search_block(q, sets, percent))

        for _, _, b, text in group:
            tokens = shingle_set(text, width)
            if b is None:
                queries.append(tokens)
            else:
                block.append((b, tokens))
                if len(block) == BLOCK:
                    search(block, queries)
                    block = []
        if block:
            search(block, queries)
        if len(out) > 5000:
            yield send()
    if out:
        yield send()


def lists_needed(a_n: Column, b_n: Column, percent: int) -> Column:
    """The lists that sets of these sizes share at least if they link.

    A link needs overlap T.  Whichever prefix ends first in the global order,
    what that set shares with the other lies in both prefixes or behind its own
    prefix, where it has least_overlap - 1 shingles.
    """
    least = [F.ceil(n * F.lit(percent) / 100.0 - 1e-9) for n in (a_n, b_n)]
    return F.ceil((a_n + b_n) * F.lit(percent) / F.lit(100.0 + percent) - 1e-9) - F.greatest(*least) + 1


def candidates(met: DataFrame, percent: int, share: float = 1.0) -> DataFrame:
    """Distinct pairs (a, b) that can still link, from one row (a, a_n, b, b_n) for each list that they share.

    ``share``: the part of their lists that the rows are sure to cover.
    """
    near = F.least("a_n", "b_n") * 100 >= percent * F.greatest("a_n", "b_n")
    need = lists_needed(F.col("a_n"), F.col("b_n"), percent)
    return (met.where(near).groupBy("a", "b", "a_n", "b_n").agg(F.count(F.lit(1)).alias("lists"))
            .where(F.col("lists") >= need * share).select("a", "b").distinct())


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """The linked ones among distinct pairs (a, b) of doc_ids, by T-occurrence search from a; stored."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = (pairs.join(blocks, "a")
             .withColumn("salt", F.pmod(F.xxhash64("b"), F.col("blocks"))))
    candidates = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "text")
    queries = (blocks.join(texts.withColumnRenamed("doc_id", "a"), "a")
               .select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("salt"),
                       F.lit(None).cast("long").alias("b"), "text"))
    grouped = (queries.unionByName(candidates).repartition("a", "salt")
               .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()))
    return saved(grouped.mapInArrow(lambda x: _search_batches(x, width, percent), "a long, b long").distinct(), name)


# --- components ------------------------------------------------------------------------

def quick_labels(edges: DataFrame, jumps: int) -> DataFrame:
    """(node, label): nodes with one label are connected, not the other way round."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    for _ in range(jumps):
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return labels


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component, for all nodes of ``edges`` (a, b)."""
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))),
                 "edges")
    labels = saved(both.groupBy(F.col("a").alias("node"))
                   .agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        lower = labels.join(near, "node").select(
            "node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("changed"))
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = saved(lower.join(up, "label").select(
            "node", F.col("up").alias("label"), (F.col("changed") | (F.col("up") < F.col("label"))).alias("changed")),
            "labels")
        labels = jumped.select("node", "label")
        if jumped.where("changed").isEmpty():
            return labels


def mixed_lists(lists: DataFrame, linked: DataFrame) -> DataFrame:
    """(token, rep, n, label, lists, place) of the lists that hold more than one label.

    lists: how many of them the rep is in; place: the list's place among these, short lists first.
    """
    labels = quick_labels(linked, 2).withColumnRenamed("node", "rep")
    labelled = (lists.select("token", "rep", "n").join(labels, "rep", "left")
                .withColumn("label", F.coalesce("label", "rep")))
    mixed = (labelled.groupBy("token")
             .agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("length"))
             .where("lo != hi").select("token", "length"))
    own = Window.partitionBy("rep")
    return labelled.join(mixed, "token").select(
        "token", "rep", "n", "label", F.count(F.lit(1)).over(own).alias("lists"),
        F.row_number().over(own.orderBy("length", "token")).alias("place"))


def hub_pairs(left: DataFrame) -> DataFrame:
    """Rows (a, a_n, b, b_n): the entries of each list with its hub, where their labels differ.

    The hub is the document in the most lists: an original is in more lists
    than its edited copies are.
    """
    hubs = left.groupBy("token").agg(F.max(F.struct("lists", "rep", "n", "label")).alias("hub"))
    return (left.join(hubs, "token").where("label != hub.label")
            .select(F.col("hub.rep").alias("a"), F.col("hub.n").alias("a_n"),
                    F.col("rep").alias("b"), F.col("n").alias("b_n")))


# --- the join ----------------------------------------------------------------------------

def linked_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row.

    Null, empty and wordless texts have an empty set and link with nothing, not
    even with each other.  Fewer words than ``width`` are one shingle.  Rows
    that repeat a doc_id are one document, which links as any of its texts
    does.  A row without doc_id takes part only as its own component (null).
    Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    python_workers(spark, 1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common = spark.sparkContext.broadcast(common_shingles(docs, width))
    rows = saved(docs.mapInArrow(lambda b: _prefix_batches(b, common.value, width, percent),
                                 "doc_id long, n long, set_key binary, prefix array<bigint>"), "prefixes")

    alive = rows.where("n > 0 and doc_id is not null")
    classes = alive.groupBy("n", "set_key").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"))
    listed = classes.select("rep", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("token"))
    by_token = Window.partitionBy("token")
    entry = F.struct("rep", "n")
    lists = saved(listed.withColumns({"low": F.min(entry).over(by_token), "high": F.max(entry).over(by_token)})
                  .where("low.rep != high.rep"), "lists")
    texts = saved(docs.where(F.col("doc_id").isNotNull())
                  .join(lists.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")

    # each document with the first and the last one of its lists; a pair's lists are counted in part, so half will do
    ends = lists.select("rep", "n", F.explode(F.array("low", "high")).alias("end")).where("rep != end.rep")
    linked = verified(candidates(ends.select(F.col("end.rep").alias("a"), F.col("end.n").alias("a_n"),
                                             F.col("rep").alias("b"), F.col("n").alias("b_n")), percent, 0.5),
                      texts, width, percent, "links")

    # then with the document of its lists that is in the most lists
    left = saved(mixed_lists(lists, linked), "mixed")
    more = candidates(hub_pairs(left), percent, 0.5)
    linked = saved(linked.unionByName(verified(more, texts, width, percent, "links")).distinct(), "links")

    # then all pairs of different labels, each from its first common lists only
    left = saved(mixed_lists(lists, linked), "mixed")
    x, y = left.alias("x"), left.alias("y")
    need = lists_needed(F.col("x.n"), F.col("y.n"), percent)
    met = (x.join(y, F.expr("x.token = y.token and x.label != y.label and (x.n < y.n or x.n = y.n and x.rep < y.rep)")
                  & (F.col("x.n") * 100 >= F.col("y.n") * percent)
                  & (F.col("x.place") <= F.col("x.lists") - need + 1) & (F.col("y.place") <= F.col("y.lists") - need + 1))
           .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), need.alias("need")).distinct())
    own = left.groupBy("rep").agg(F.collect_list("token").alias("tokens"))  # a prefix at most
    rest = (met.join(own.select(F.col("rep").alias("a"), F.col("tokens").alias("a_tokens")), "a")
            .join(own.select(F.col("rep").alias("b"), F.col("tokens").alias("b_tokens")), "b")
            .where(F.size(F.array_intersect("a_tokens", "b_tokens")) >= F.col("need")).select("a", "b"))
    linked = linked.unionByName(verified(rest, texts, width, percent, "links"))

    labels = components(linked)
    classed = (rows.select("doc_id", "n", "set_key")
               .join(classes.select("n", "set_key", "rep"), ["n", "set_key"], "left"))
    return (classed.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("label", "rep", "doc_id").alias("component_id")))
