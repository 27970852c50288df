"""Best-fit packing of documents into fixed-length token sequences.

Best-fit decreasing over all pieces of the corpus.  Lengths are integers up to
the sequence length, so the whole corpus is described by a histogram of at most
``capacity`` entries, and all pieces of one length are placed at once:

1. tokenise and cut (narrow, Arrow batches); only lengths and checksums go on;
2. histogram by (length, salt), summed by length on the driver (``capacity`` rows);
3. best-fit decreasing over the histogram with a segment tree over remaining
   capacities: each step finds the tightest open capacity that still fits in
   logarithmic time and fills all bins of that capacity with equal pieces;
4. the steps are ranges of ranks within a length; each piece looks up its own
   rank's range, so placing is a narrow operation again.

The result equals sequential best-fit decreasing.  A piece's rank is its row
number within (length, salt) plus the rows of the salts before; the number of
salts follows the row count, so a length shared by a third of all pieces is
never ranked in one task.
"""

from __future__ import annotations

import base64
import functools
import os
import struct
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civiccases.llm.common import saved, python_workers

CAPACITY = 1024
EOS_ID = 2
#: rows ranked in one window group, on average
ROWS_PER_SALT = 20_000
#: entries of a worker's word cache; it is emptied when full
CACHE_ENTRIES = 600_000

PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- tokenising -----------------------------------------------------------------

class WordCache(dict):
    """word -> its ids as bytes; encodes a word when it is first looked up."""

    def __init__(self, word_ids):
        super().__init__()
        self.word_ids = word_ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        found = self[word] = id_bytes(self.word_ids(word))
        return found


def id_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


# character classes: unknown, letter, digit, other, space, other white space
UNKNOWN, LETTER, DIGIT, OTHER, SPACE, WHITE = range(6)
LAST_KNOWN = 0x24F  # beyond Latin no class is claimed


def _classes() -> np.ndarray:
    def of(c: str) -> int:
        if c in "\0\x1c\x1d\x1e\x1f\x85":
            return UNKNOWN
        if c == " ":
            return SPACE
        if c.isspace():
            return WHITE
        kind = unicodedata.category(c)[0]
        return LETTER if kind == "L" else DIGIT if kind == "N" else OTHER
    return np.array([*map(of, map(chr, range(LAST_KNOWN + 1))), UNKNOWN], np.uint8)


CLASS = _classes()
# before a character of the second class after one of the first, every pre-token ends
ENDS = np.zeros(64, bool)
for _a in (LETTER, DIGIT, OTHER):
    ENDS[[8 * _a + SPACE, 8 * _a + WHITE, 8 * WHITE + _a]] = True
ENDS[[8 * LETTER + OTHER, 8 * DIGIT + OTHER, 8 * LETTER + DIGIT, 8 * DIGIT + LETTER]] = True


def split_words(text: str) -> list[str]:
    """Cut a text (without NUL) where the byte-level pre-tokeniser surely cuts it too.

    A piece encodes to the same ids alone as in its place: cuts lie after a
    letter, digit or sign before white space, between letters, digits and the
    signs after them, and after a single line break or tab (a longer run of
    white space is split by what follows it).
    """
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kind = CLASS[np.minimum(points, LAST_KNOWN + 1)]
    ends = ENDS[kind[:-1] * 8 + kind[1:]]
    runs = np.flatnonzero((kind[1:-1] == WHITE) & ((kind[:-2] >= SPACE) | (kind[:-2] == UNKNOWN)))
    ends[runs + 1] = False
    return np.insert(points, np.flatnonzero(ends) + 1, 0).tobytes().decode("utf-32-le").split("\0")


class WordEncoder:
    """Token ids of a text as little-endian uint32 bytes, through a cache of words.

    Texts with a NUL or with the text of a special token are encoded whole by
    the tokenizer itself.
    """

    def __init__(self, tokenizer_file: str):
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = ["\0", *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.cache = WordCache(self._word_function(tokenizer_file))

    def _word_function(self, tokenizer_file: str):
        """The same ids from the rank file beside the tokenizer, where there is one (faster)."""
        ranks = os.path.splitext(tokenizer_file)[0] + ".tiktoken"
        if not os.path.exists(ranks):
            return self._whole
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                 special_tokens={}).encode_ordinary

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return id_bytes(self._whole(text))
        return b"".join(map(self.cache.__getitem__, split_words(text)))


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer_file: str) -> WordEncoder:
    return WordEncoder(tokenizer_file)


def cut(n_ids: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    first = n_ids % capacity or capacity
    if n_ids <= capacity:
        return [(0, n_ids)]
    return [(0, first), *((s, capacity) for s in range(first, n_ids, capacity))]


def _piece_batches(batches: Iterator[pa.RecordBatch], tokenizer_file: str, capacity: int):
    encode = _encoder(tokenizer_file)
    eos = np.asarray([EOS_ID], "<u4").tobytes()
    for batch in batches:
        doc, piece, start, length, crc = [], [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = encode(text.as_py() or "") + eos
            for k, (s, n) in enumerate(cut(len(data) // 4, capacity)):
                doc.append(doc_id)
                piece.append(k)
                start.append(s)
                length.append(n)
                crc.append(zlib.crc32(data[4 * s:4 * (s + n)]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document's ids plus the end id; null text is an empty document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda batches: _piece_batches(batches, tokenizer_file, capacity), PIECES_SCHEMA)


# --- best-fit decreasing over a histogram ------------------------------------------

class CapacityTree:
    """Segment tree over remaining capacities 0..n; finds the tightest open one >= a length."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        node = capacity + self.size
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        node = length + self.size
        if not self.open[node]:
            # climb until an open right sibling is found, then go down leftmost
            while node > 1 and (node % 2 or not self.open[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing for ``histogram[length] = pieces``.

    Rows (length, first rank, first bin, pieces per bin, first offset): the
    pieces from that rank on go to consecutive bins, so many to each, from that
    offset on.  Equal pieces fill the tightest bin until it is too small, as
    they do one by one.  Every step ends a length or uses up a run of bins, and
    a length adds two runs at most, so the plan is bounded by ``capacity``
    alone, whatever the number of pieces.
    """
    tree = CapacityTree(capacity)
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining capacity -> (first bin, bins)
    bins, plan = 0, []

    def give(room: int, first: int, n: int) -> None:
        if n and room:
            runs[room].append((first, n))
            tree.set(room, True)

    for length in sorted((k for k, v in histogram.items() if v), reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            each = room // length
            placed = min(left, n * each)
            full, rest = divmod(placed, each)
            plan.append((length, rank, first, each, capacity - room))
            give(room - each * length, first, full)
            if rest:
                give(room - rest * length, first + full, 1)
            used = full + (rest > 0)
            give(room, first + used, n - used)
            left -= placed
            rank += placed
    return np.array(plan, dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` from 1 to ``capacity``.

    ``pieces`` must be stored (it is read twice).  Repeated rows are placed
    separately; an empty input gives an empty result.
    """
    total = pieces.count()
    salts = max(1, -(-total // ROWS_PER_SALT))
    keys = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    counted = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    # at most `capacity` rows, whatever the input
    histogram = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("_n")).collect()}
    if any(k is None or not 0 < k <= capacity for k in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = best_fit_plan(histogram, capacity)

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy(*keys)
    ranked = (salted.withColumn("_row", F.row_number().over(within) - 1)
              .join(base, ["length", "_salt"])
              .withColumn("_rank", F.col("_base") + F.col("_row")))

    step = np.int64(total + 1)
    starts = plan[:, 0] * step + plan[:, 1]
    order = np.argsort(starts)
    starts, plan = starts[order], plan[order]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        ln, rk = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = plan[np.searchsorted(starts, ln * step + rk, side="right") - 1]
        at = rk - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + at // row[:, 3],
                             "offset": row[:, 4] + at % row[:, 3] * ln})

    placed = ranked.withColumn("_at", place("length", "_rank"))
    return placed.select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place in sequences of ``capacity`` tokens.

    Null or empty text is one piece holding the end id.  Repeated rows and
    doc_ids are packed once each.  Extra columns are ignored.  The tokenizer
    file must be readable on the executors.
    """
    python_workers(docs.sparkSession)
    pieces = saved(token_pieces(docs, tokenizer_file, capacity), "pieces")
    return pack(pieces, capacity)
