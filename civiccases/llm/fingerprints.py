"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

A text's 5-word shingles are hashed once.  The low bits of a hash pick one of
256 bins, the rest is the value; a bin keeps its smallest value.  An empty bin
copies the bin that its own universal hash sequence (a function of the bin and
the attempt alone) meets first among the filled ones, so two texts fill a bin
alike wherever their filled bins agree.  4 bits of a hash of each value and
its bin are packed into 16 longs (a text of one shingle lends one value to all
bins, so the value's own bits would say the same 256 times).  Likeness: the share of equal bins, corrected for chance
equality: (share - 1/16) / (1 - 1/16), at 0 from below.

All steps are array functions within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiccases.llm.common import clean_text, shingle_hashes, word_array

BINS = 256
BITS = 4
VALUE_BITS = 47
EMPTY = (1 << VALUE_BITS) - 1
ATTEMPTS = 12
WORDS = BINS * BITS // 64
BY_WORD = 64 // BITS
#: documents that are sorted together for their neighbours, on average, and the most groups
BUCKET_ROWS, MAX_BUCKETS = 4000, 64 ** 3


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bin_minima(text: Column) -> Column:
    """256 smallest values, by bin; EMPTY for a bin without shingle."""
    keyed = F.transform(
        shingle_hashes(word_array(text)),
        lambda h: F.shiftleft(h.bitwiseAND(F.lit(BINS - 1).cast("long")), VALUE_BITS)
        .bitwiseOR(F.shiftrightunsigned(h, 64 - VALUE_BITS)))
    # one EMPTY entry a bin sorts behind the bin's values, so each bin has a first entry
    empties = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")),
                          lambda b: F.shiftleft(b, VALUE_BITS).bitwiseOR(F.lit(EMPTY)))

    def firsts(keys: Column) -> Column:
        at = F.filter(keys, lambda x, i: (i == 0) | (F.shiftright(x, VALUE_BITS)
                                                     != F.shiftright(F.get(keys, i - 1), VALUE_BITS)))
        return F.transform(at, lambda x: x.bitwiseAND(F.lit(EMPTY)))

    return _bind(F.sort_array(F.concat(keyed, empties)), firsts)


def _densified(minima: Column) -> Column:
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    filled = F.filter(F.transform(minima, lambda v, i: F.struct(i.alias("bin"), v.alias("v"))),
                      lambda x: x["v"] != EMPTY)

    def fill(both: Column) -> Column:
        def one(b: Column) -> Column:
            tries = [F.nullif(F.get(both["minima"], F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)).cast("int")),
                              F.lit(EMPTY)) for t in range(ATTEMPTS)]
            # beyond the attempts: the filled bin that comes first in the bin's own order
            rest = F.array_min(F.transform(both["filled"], lambda x: F.struct(
                F.xxhash64(b, x["bin"], F.lit(ATTEMPTS)).alias("h"), x["v"].alias("v"))))["v"]
            return F.coalesce(F.nullif(F.get(both["minima"], b), F.lit(EMPTY)), *tries, rest)
        return F.transform(bins, one)

    return _bind(F.struct(minima.alias("minima"), filled.alias("filled")), fill)


def signature(text: Column) -> Column:
    """Packed low-order bits of the 256 bins as 16 longs; an empty array for a text without words."""
    def packed(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.aggregate(
            F.slice(values, w * BY_WORD + 1, F.lit(BY_WORD)), F.lit(0).cast("long"),
            lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v)))

    def low_bits(values: Column) -> Column:
        # of a hash of value and bin, so that a value lent to several bins is a trial of its own in each
        return F.transform(values, lambda v, i: F.xxhash64(v, i).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")))

    def checked(minima: Column) -> Column:
        none = F.forall(minima, lambda v: v == EMPTY)
        return F.when(none, F.array().cast("array<bigint>")).otherwise(_bind(low_bits(_densified(minima)), packed))

    return _bind(_bin_minima(text), checked)


def as_hex(sig: Column) -> Column:
    return F.concat_ws("", F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two signatures, 0 to 1; two empty ones are alike (1), an empty and a filled not (0)."""
    ones = F.lit(0x1111111111111111).cast("long")

    def unequal(x: Column) -> Column:
        half = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(half.bitwiseOR(F.shiftrightunsigned(half, 1)).bitwiseAND(ones))

    differing = F.aggregate(F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    share = 1 - differing / F.lit(float(BINS))
    chance = 1 / (1 << BITS)
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), (share - chance) / (1 - chance))))


def _descending_buckets(ids: DataFrame) -> tuple[list[int], list[int]]:
    """Lower bounds of ranges of doc_ids of about equal size, and the largest doc_id in each."""
    n = ids.count()
    parts = min(MAX_BUCKETS, max(1, n // BUCKET_ROWS))
    ranges = (ids.repartitionByRange(parts, "_id").groupBy(F.spark_partition_id())
              .agg(F.min("_id").alias("low"), F.max("_id").alias("high")).orderBy("low").collect())
    return [r["low"] for r in ranges], [r["high"] for r in ranges]


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column>: the row's successor by descending doc_id; after the last row comes the first.

    Ranges of doc_ids are sorted separately; the largest row of each range is
    also sent to the range above, as that one's last successor.
    """
    ids = docs.select(F.coalesce("doc_id", F.lit(-2 ** 63)).alias("_id"))
    low, high = _descending_buckets(ids)
    if not low:
        return docs.withColumns({f"next_{c}": F.col(c) for c in columns})
    # the range of an id, by two steps over groups of bounds
    step = max(1, int(len(low) ** 0.5))
    groups = [low[i:i + step] for i in range(0, len(low), step)]
    heads = F.lit([g[0] for g in groups])
    tails = F.array(*[F.lit(g) for g in groups])
    rows = docs.withColumn("_id", F.coalesce("doc_id", F.lit(-2 ** 63)))
    rows = rows.withColumn("_g", F.size(F.filter(heads, lambda x: x <= F.col("_id"))) - 1)
    rows = rows.withColumn("_b", F.col("_g") * step + F.size(
        F.filter(F.get(tails, F.col("_g")), lambda x: x <= F.col("_id"))) - 1)
    last = F.get(F.lit(high), F.col("_b")) == F.col("_id")
    above = (F.col("_b") + 1) % len(low)
    # (range, 1 for a row that only serves as a successor)
    places = F.when(last, F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("guest")),
                                  F.struct(above.alias("b"), F.lit(1).alias("guest"))))
    own = F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("guest")))
    rows = rows.withColumn("_at", F.explode(F.coalesce(places, own))).withColumns(
        {"_bucket": F.col("_at.b"), "_guest": F.col("_at.guest")})
    order = Window.partitionBy("_bucket").orderBy("_guest", F.desc("_id"), F.xxhash64(*columns))
    ahead = {f"next_{c}": F.lead(c).over(order) for c in columns}
    return rows.withColumns(ahead).where("_guest = 0").drop("_id", "_g", "_b", "_at", "_bucket", "_guest")


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, with their likeness.

    Edited: the last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document's.  Null text is empty; an empty or
    wordless text has the empty fingerprint.  Rows that repeat a doc_id follow
    each other; a row without doc_id comes last.  Extra columns are ignored;
    an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text("text").alias("text"))
    rows = with_next(rows.withColumn("sig", signature(F.col("text"))), ["text", "sig"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = (rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
            .withColumn("edited_sig", signature(F.col("edited"))))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       as_hex(F.col("sig")).alias("fingerprint"), as_hex(F.col("edited_sig")).alias("edited_fingerprint"),
                       likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
                       likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
