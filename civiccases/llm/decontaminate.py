"""Benchmark decontamination: short test items inside long documents.

Containment of an item in a document: the share of the item's distinct 5-word
shingles that occur in the document.  A pair leaks at ``threshold`` or more.

Search: items are partitioned by size (powers of two of their shingle number).
An item's sketch holds its k smallest shingle hashes, with k from the upper
size u of its partition: u - ceil(threshold * u) + 1.  A document that holds
the threshold share of an item misses fewer than k of its shingles, so it holds
one of the sketch, whatever the document's length: recall is 1.

1. All documents are probed with the sketches alone: their shingles stream
   through one hash join with the sketch shingles; what meets is a candidate
   pair.  Documents are not shuffled.
2. Only candidate documents are read again, and only the shingles of their
   candidate items are looked up: exact containment decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiccases.llm.common import clean_text, saved, shingle_hashes, word_array

THRESHOLD = 0.8
WIDTH = 5
#: item shingles, or candidate pairs, up to this number are broadcast (about 40 bytes each); more are joined by a shuffle
BROADCAST_ROWS = 500_000


def _shingles(text: Column, width: int) -> Column:
    return shingle_hashes(word_array(text), width)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sketch_size(upper: Column, threshold: float) -> Column:
    """Shingles in the sketch of an item of the partition whose largest size is ``upper``."""
    return upper - F.ceil(upper * threshold - 1e-9) + 1


def with_identity(rows: DataFrame, name: str, as_id: str = "id", as_key: str = "key") -> DataFrame:
    """Adds the id (null as the least long) and a digest of the text: rows are the same only if both are."""
    text = clean_text(F.col("text").cast("string"))
    return rows.withColumns({as_id: F.coalesce(F.col(name).cast("long"), F.lit(-2 ** 63)),
                             as_key: F.unhex(F.md5(text.cast("binary")))})


def item_shingles(benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(item, item_id, q, h, in_sketch): the distinct shingles of each item and those in its sketch.

    ``item`` tells items apart by item_id and set of shingles; repeated rows are one item.
    """
    sets = (benchmark.select("item_id", F.array_sort(F.array_distinct(_shingles(clean_text("text"), width))).alias("set"))
            .where(F.size("set") > 0).dropDuplicates(["item_id", "set"])
            .withColumns({"q": F.size("set"), "item": F.xxhash64("item_id", "set")}))
    k = sketch_size(F.pow(2, F.floor(F.log2("q")) + 1) - 1, threshold)
    return (sets.select("item", "item_id", "q", k.alias("k"), F.posexplode("set").alias("pos", "h"))
            .select("item", "item_id", "q", "h", (F.col("pos") < F.col("k")).alias("in_sketch")))


def candidates(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, key, item): documents (by ``with_identity``) that hold a shingle of an item's sketch."""
    sketch = _small(saved(items.where("in_sketch").select("item", "h"), "sketch"))
    return (docs.select("id", "key", F.explode(_shingles(clean_text("text"), width)).alias("h"))
            .join(sketch, "h").select("id", "key", "item").distinct())


def found_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(id, key, doc_id, item_id, q, shared) of all pairs of a document and an item that leak."""
    docs = with_identity(docs.select("doc_id", "text"), "doc_id")
    items = saved(item_shingles(benchmark, threshold, width), "items")
    pairs = saved(candidates(docs, items, width), "candidates")
    suspects = _small(saved(pairs.groupBy("id", "key").agg(F.collect_set("item").alias("wanted")), "suspects"))
    again = docs.join(suspects, ["id", "key"]).select(
        "id", "key", "doc_id", "wanted", F.explode(_shingles(clean_text("text"), width)).alias("h"))
    wanted = _small(saved(items.join(pairs.select("item").distinct(), "item", "left_semi"), "wanted"))
    return (again.join(wanted, "h").where(F.array_contains("wanted", F.col("item")))
            .select("id", "key", "doc_id", "item", "item_id", "q", "h").distinct()
            .groupBy("id", "key", "doc_id", "item", "item_id", "q").agg(F.count(F.lit(1)).alias("shared"))
            .where(F.col("shared") / F.col("q") >= threshold - 1e-12))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """Pairs with containment >= threshold: doc_id, item_id, item_shingles, shared, containment.

    Null, empty and wordless texts and items match nothing.  A text of fewer
    than ``width`` words is one shingle and equals only itself.  Rows are told
    apart by id and text: rows that repeat both are one, rows that share a
    doc_id (or have none) are judged each by its own text; so are items.  A
    (doc_id, item_id) is listed once, with its best containment.  Extra columns
    are ignored; an empty table gives no pairs.
    """
    pairs = found_pairs(docs, benchmark, threshold, width).withColumn("containment", F.col("shared") / F.col("q"))
    return (pairs.groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("containment", "shared", "q")).alias("best"))
            .select("doc_id", "item_id", F.col("best.q").cast("long").alias("item_shingles"),
                    F.col("best.shared").alias("shared"), F.col("best.containment").alias("containment")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item.

    Each row goes or stays by its own text, whatever other rows share its doc_id.
    """
    leaking = saved(found_pairs(docs, benchmark, threshold).select(
        F.col("id").alias("_leak"), F.col("key").alias("_leak_key")).distinct(), "leaks")
    marked = with_identity(docs, "doc_id", "_me", "_my_key")
    return marked.join(leaking, (F.col("_me") == F.col("_leak")) & (F.col("_my_key") == F.col("_leak_key")),
                       "left_anti").drop("_me", "_my_key")
