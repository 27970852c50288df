"""Spelling variants: rare words one edit away from a much commoner word, grouped under it.

Reduced-alphabet generation: each letter is hashed to one of a few symbols, so a
word has a reduced word.  Two words that differ by one edit have reduced words
that are equal or differ by one edit.  For every distinct reduced word the full
neighbourhood of one edit is generated over the few symbols (about 150 reduced
words for ten letters and eight symbols, whatever the real alphabet), joined
with the reduced vocabulary, and the words behind both are verified on the
original strings.  No pair is lost, and no reduced word is compared with all others.

Reduced words travel as 64-bit polynomial hashes; neighbours' hashes follow from
prefix sums without building strings.  Before the shuffle a bitmap of the
reduced vocabulary removes neighbours that no word has; a vocabulary too large
for a bitmap of bounded size is joined without it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiccases.llm.common import clean_text, python_workers, saved

SYMBOLS = 8
MIN_LETTERS, MIN_COUNT, RATIO, ERODE = 7, 2, 10, 31
#: positions of the bitmap for a reduced word, and its largest size in bits (32 MB); beyond it there is no bitmap
BITS_A_WORD, MAX_BITS = 16, 1 << 28
#: reduced words whose neighbourhoods are generated together
CHUNK = 4000

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2 ** 64)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- vocabulary ----------------------------------------------------------------------------

def words_of(docs: DataFrame, min_letters: int = MIN_LETTERS, erode: int = ERODE) -> DataFrame:
    """(word): every run of at least ``min_letters`` letters of the texts, A-Z lower-cased.

    With ``erode``, a run for which it divides h = crc32("doc_id:run") loses its
    letter h % length, as a slip of the pen would; 0 leaves all runs as they are.
    """
    text = F.translate(clean_text(F.col("text").cast("string")), _UPPER, _LOWER)
    runs = F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{min_letters},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if not erode:
        return rows.select(F.col("run").alias("word"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return (rows.select(F.when(F.col("h") % erode == 0, cut).otherwise(F.col("run")).alias("word"))
            .where(F.length("word") >= min_letters))


def vocabulary(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of words with at least ``min_count`` occurrences; counted map-side first, so no word is hot."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# --- reduced words and their neighbourhoods ------------------------------------------------

def symbol_of(letters: np.ndarray, symbols: int) -> np.ndarray:
    """The symbol of each code point, by a hash."""
    return ((letters.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(symbols)


def _symbol_values(symbols: int) -> np.ndarray:
    return np.array([zlib.crc32(b"%d" % s) * 0x2545F4914F6CDD1D % 2 ** 64 | 1 for s in range(symbols)], np.uint64)


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _BASE, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, matrix of code points) for each word length."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, np.frombuffer("".join(words[i] for i in at.tolist()).encode("utf-32-le"), "<u4").reshape(-1, n)


def reduced_hashes(words: list[str], symbols: int) -> np.ndarray:
    """A hash of each word's reduced word, as int64."""
    out, values = np.zeros(len(words), np.uint64), _symbol_values(symbols)
    for at, letters in _by_length(words):
        out[at] = (values[symbol_of(letters, symbols)] * _powers(letters.shape[1])).sum(axis=1, dtype=np.uint64)
    return _mixed(out).view(np.int64)


def neighbourhood(reduced: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every reduced word that is at most one edit away from a row of symbols of equal length.

    The word itself comes first.  A deletion counts at the first of a run of
    equal symbols, an insertion of a symbol only behind such a run, so every
    neighbour is generated once.
    """
    n, length = reduced.shape
    values, up = _symbol_values(symbols), _powers(length + 1)
    terms = values[reduced] * up[:length]
    before = np.concatenate((np.zeros((n, 1), np.uint64), np.add.accumulate(terms, axis=1, dtype=np.uint64)), axis=1)
    whole = before[:, -1:]
    rows, hashes = [np.arange(n)], [whole[:, 0]]

    def take(found: np.ndarray, wanted: np.ndarray) -> None:
        r, c = np.nonzero(wanted)
        rows.append(r)
        hashes.append(found[r, c])

    first_of_run = np.ones((n, length), bool)
    first_of_run[:, 1:] = reduced[:, 1:] != reduced[:, :-1]
    take(before[:, :-1] + (whole - before[:, 1:]) * np.uint64(_INVERSE), first_of_run)
    for s in range(symbols):
        other = reduced != s
        take(whole - terms + values[s] * up[:length], other)
        behind = np.concatenate((other, np.ones((n, 1), bool)), axis=1)
        take(before + values[s] * up + (whole - before) * np.uint64(_BASE), behind)
    return np.concatenate(rows), _mixed(np.concatenate(hashes))


def _hash_batches(batches: Iterator[pa.RecordBatch], symbols: int):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(reduced_hashes(batch.column(0).to_pylist(), symbols))], names=["word", "n", "h"])


def _neighbour_batches(batches: Iterator[pa.RecordBatch], symbols: int, bitmap):
    """(source, target) hashes; a source is a reduced word, given by any word that has it."""
    bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            sources = part.column(0).to_numpy()
            for index, letters in _by_length(part.column(1).to_pylist()):
                rows, hashes = neighbourhood(symbol_of(letters, symbols).astype(np.int64), symbols)
                if bits is not None:
                    known = in_bitmap(bits, hashes)
                    rows, hashes = rows[known], hashes[known]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sources[index[rows]]), pa.array(hashes.view(np.int64))], names=["source", "target"])


# --- bitmap --------------------------------------------------------------------------------

def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both positions of a hash are set."""
    mask = np.uint64(len(bits) * 8 - 1)
    out = np.ones(len(hashes), bool)
    for at in (hashes & mask, (hashes >> np.uint64(32)) & mask):
        out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
    return out


def bitmap_of(words: DataFrame, n: int) -> bytes | None:
    """Two positions of every hash ``h`` set in a power of two of bits; None beyond ``MAX_BITS``."""
    size = max(1 << 15, 1 << (BITS_A_WORD * n - 1).bit_length())
    if size > MAX_BITS:
        return None
    mask = F.lit(size - 1).cast("long")
    at = F.explode(F.array(F.col("h").bitwiseAND(mask) + 1, F.shiftrightunsigned("h", 32).bitwiseAND(mask) + 1))
    pieces = (words.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("piece"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")))
    out = np.zeros(size // 8, np.uint8)
    for r in pieces.collect():  # size / 8 bytes at most
        out[(r["piece"] - 1) << 12:r["piece"] << 12] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


# --- the operator --------------------------------------------------------------------------

def near_words(vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): all pairs of words that differ by exactly one inserted, deleted or replaced code point."""
    spark = vocab.sparkSession
    python_workers(spark, 20_000)
    words = saved(vocab.select("word", "n").mapInArrow(lambda b: _hash_batches(b, symbols), "word string, n long, h long"), "words")
    bits = bitmap_of(words, words.count())
    bitmap = None if bits is None else spark.sparkContext.broadcast(bits)
    # words of one reduced word share a neighbourhood; words whose hashes collide are all asked for theirs
    forms = words.groupBy("h", F.translate("word", *_letter_table(symbols)).alias("reduced")).agg(F.min("word").alias("word"))
    met = saved(forms.select("h", "word").mapInArrow(lambda b: _neighbour_batches(b, symbols, bitmap), "source long, target long")
                .join(words.select(F.col("h").alias("target"), F.col("word").alias("near"), F.col("n").alias("near_n")), "target")
                .select("source", "near", "near_n"), "met")
    return (words.join(met, words["h"] == met["source"])
            .where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n").distinct())


def _letter_table(symbols: int) -> tuple[str, str]:
    """Letters and their symbols, for ``translate``; the two sides may share characters."""
    points = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
    return "".join(map(chr, points)), "".join(chr(0x2460 + int(s)) for s in symbol_of(np.array(points), symbols))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), the form never null: forms are followed to the last one.

    Each round doubles the steps taken, so a chain of 18 forms (counts grow by
    the ratio at each) takes five rounds.
    """
    reached = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = reached.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        if reached.join(ahead, F.col("root") == F.col("_at"), "left_semi").isEmpty():
            return reached
        reached = saved(reached.join(ahead, F.col("root") == F.col("_at"), "left")
                        .select("word", F.coalesce("_next", "root").alias("root")), "roots")


def variant_groups(vocab: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``vocab`` (word, n; words distinct).

    The form is the near word of largest n (ties: smallest in code-point order)
    if that is at least ``ratio`` times the word's n, else null with a null
    form_n; the root is the last of the chain of forms, the word itself if it
    has none; n_near is 0 for a word without near words.  An empty vocabulary
    gives an empty result.
    """
    vocab = saved(vocab.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form")))
    near = saved(near_words(vocab, symbols).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
                 .select("word", "n_near", F.when(-F.col("best.minus") >= ratio * F.col("n"), F.struct(
                     F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))).alias("best")), "near")
    rooted = roots(near.where("best is not null").select("word", F.col("best.form").alias("form")))
    return (vocab.join(near, "word", "left").join(rooted, "word", "left").select(
        "word", F.col("best.form").alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.form_n").alias("form_n")))


def spelling_table(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO,
                   erode: int = ERODE, symbols: int = SYMBOLS) -> DataFrame:
    """``variant_groups`` of the words of all texts.

    Null, empty and letterless texts have no words; a null doc_id counts as an
    empty one in the hash; repeated rows count each.  Extra columns are ignored;
    an empty table gives an empty result.
    """
    return variant_groups(vocabulary(words_of(docs, min_letters, erode), min_count), ratio, symbols)
