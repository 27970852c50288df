"""Repeated passages by suffix order and previous factors.

A byte is covered if it lies in a string of ``length`` bytes that also starts
somewhere else.  ``keep_first`` removes only strings with an earlier match (in
the order of doc_id, text digest and position), else both copies go.

1. Each window of ``length`` bytes is assigned to its smallest hash of
   ANCHOR-byte strings.  That value depends on the window's bytes alone, so
   equal windows have equal values; windows next to each other mostly share
   it.  A maximal run of starts with one value is a segment: some 170 starts,
   one row (value, digest of the segment's bytes).
2. Segments with equal digests are one class.  Where a class has several
   rows, all but its first row are covered as a whole; no bytes are moved.
3. Values with several classes (ends of passages, edited copies) need a look
   inside: the first segment of each class is sent to its value's group.
   Groups are put into blocks of bounded size; in a block, suffixes are sorted
   by prefix doubling up to ``length`` bytes, ties by position.  A window's
   previous smaller position in that order is its predecessor if the two are
   equal, so its longest previous factor reaches ``length`` exactly if the
   predecessor has its rank (and its next factor if the successor has).
4. A group too large for a block is settled by counting window hashes with a
   shuffle instead; nothing is capped.

Classes and counts are partially aggregated before every shuffle, so a passage
that a third of all documents share costs one row per task.

``passage_removals`` runs the same steps over words: a text's words become codes
of four bytes each, so passages are runs of so many words whatever their bytes
and the white space between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiccases.llm.common import clean_text, python_workers, saved

LENGTH = 400
ANCHOR = 64
#: starts hashed together, bytes sorted together, classes of a value that are sorted in one block
CHUNK = 1 << 19
BLOCK_BYTES = 1 << 19
GROUP_CLASSES = 3000

_rng = np.random.default_rng(11)
_BYTE = _rng.integers(0, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2 ** 64))
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 14)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def string_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all strings of ``width`` bytes, by their bytes alone."""
    up, down = _power_table(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(_BYTE[data] * up)))
    n = len(data) - width + 1
    return _mixed((sums[width:] - sums[:-width]) * down[:n])


def sliding(values: np.ndarray, width: int, best=np.minimum, fill: int = 2 ** 64 - 1) -> np.ndarray:
    """The least (or by ``best``, greatest) of each ``width`` values, in linear time."""
    n = len(values)
    padded = np.full(-(-n // width) * width, fill, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n - width + 1], ahead[width - 1:n])


def segments(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> list[tuple[int, int, int, int, bool]]:
    """(value, digest, first start, end of starts, may repeat within) of a text's runs of windows."""
    out = []
    width = length - anchor + 1
    whole = np.frombuffer(text, np.uint8)
    for begin in range(0, len(text) - length + 1, CHUNK):
        data = whole[begin:begin + CHUNK + length - 1]
        hashes = string_hashes(data, anchor)
        least = sliding(hashes, width)
        # strings that are some window's least one; a value with two of them may repeat within a segment
        reach = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
        chosen, times = np.unique(hashes[sliding(reach, width, np.maximum, 0) == hashes], return_counts=True)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(least)) + 1, [len(least)])).tolist()
        values = least[cuts[:-1]]
        twice = times[np.searchsorted(chosen, values)] > 1
        for a, b, v, t in zip(cuts[:-1], cuts[1:], values.view(np.int64).tolist(), twice.tolist(), strict=True):
            piece = text[begin + a:begin + b + length - 1]
            out.append((v, xxhash.xxh3_64_intdigest(piece, 7) - 2 ** 63, begin + a, begin + b, t))
    return out


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


# --- words as codes --------------------------------------------------------------------

#: bytes of a word's code; of anchors when codes are compared
CODE, CODE_ANCHOR = 4, 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space."""
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8)))
    return edges[::2], edges[1::2]


def word_codes(text: str) -> bytes:
    """Four hash bytes of every word, in order; hashed by prefix sums over pieces cut at white space."""
    data = np.frombuffer(utf8(text), np.uint8)
    starts, ends = word_bounds(data)
    out = []
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        a, b = starts[at:upto] - starts[at], ends[at:upto] - starts[at]
        piece = data[starts[at]:ends[upto - 1]]
        up, down = _power_table(len(piece))
        sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(_BYTE[piece] * up)))
        out.append((_mixed((sums[b] - sums[a]) * down[a]) >> np.uint64(32)).astype("<u4").tobytes())
        at = upto
    return b"".join(out)


def _segment_batches(batches: Iterator[pa.RecordBatch], length: int, code=utf8, anchor: int = ANCHOR):
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            ids, keys, rows = [], [], []
            part = batch.slice(at, 200)
            for i, key, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                found = segments(code(text), length, anchor)
                rows += found
                ids += [i] * len(found)
                keys += [key] * len(found)
            if rows:
                v, d, a, b, t = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(v, pa.int64()),
                     pa.array(d, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(t)],
                    names=["id", "key", "value", "digest", "a", "b", "twice"])


# --- suffix order ----------------------------------------------------------------------

def prefix_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the ``length`` bytes at ``starts`` (equal bytes, equal rank), by prefix doubling."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(length, np.uint8))).astype(np.uint64)
    done = min(8, length)
    key = np.zeros(n, np.uint64)
    for j in range(done):
        key = (key << np.uint64(8)) | padded[j:n + j]
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while 2 * done <= length:
        ahead = np.concatenate((rank[done:], np.zeros(done, np.int64)))
        rank = np.unique(rank * n + ahead, return_inverse=True)[1].astype(np.int64)
        done *= 2
    if done < length:  # the two prefixes overlap
        return np.unique(rank[starts] * n + rank[starts + length - done], return_inverse=True)[1]
    return np.unique(rank[starts], return_inverse=True)[1]


def neighbours(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an earlier match, has a later match) of each window, from its neighbours in suffix order."""
    order = np.argsort(ranks, kind="stable")  # suffix order, ties by position
    same = np.diff(ranks[order]) == 0
    earlier, later = np.zeros(len(ranks), bool), np.zeros(len(ranks), bool)
    earlier[order[1:]] = same    # the predecessor is the previous smaller position
    later[order[:-1]] = same
    return earlier, later


def block_spans(rows: list[tuple], length: int, keep_first: bool) -> list[tuple]:
    """(id, key, from, to) of covered bytes; rows: (value, id, key, a, count, bytes) in order of (value, id, key, a)."""
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    sizes = np.array([len(r[5]) for r in rows])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    starts = np.concatenate([np.arange(o, o + s - length + 1) for o, s in zip(offsets[:-1], sizes, strict=True)])
    earlier, later = neighbours(prefix_ranks(data, starts, length))
    covered = earlier if keep_first else earlier | later
    out, at = [], 0
    for (_, i, key, a, count, piece) in rows:
        n = len(piece) - length + 1
        if keep_first or count == 1:  # the other classes are covered as a whole already
            own = np.flatnonzero(np.diff(np.concatenate(([0], covered[at:at + n].astype(np.int8), [0]))))
            out += [(i, key, a + int(x), a + int(y) + length - 1) for x, y in zip(own[::2], own[1::2], strict=True)]
        at += n
    return out


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    i, key, a, b = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int64()), pa.array(key, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
        names=["id", "key", "a", "b"])


def _block_batches(batches: Iterator[pa.RecordBatch], length: int, keep_first: bool):
    """Rows sorted by (value, id, key, a); a block holds whole groups of a value."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                yield _span_batch(block_spans(held, length, keep_first))
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held:
        yield _span_batch(block_spans(held, length, keep_first))


def _window_batches(batches: Iterator[pa.RecordBatch], length: int):
    """(value, hash, id, key, start) of every window of the segments of large groups."""
    for batch in batches:
        for value, i, key, a, _, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h = string_hashes(np.frombuffer(piece, np.uint8), length).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(h), value)), pa.array(h), pa.array([i] * len(h), pa.int64()),
                 pa.array([key] * len(h), pa.binary()), pa.array(np.arange(a, a + len(h)))],
                names=["value", "hash", "id", "key", "a"])


# --- the operator ------------------------------------------------------------------------

def with_identity(docs: DataFrame) -> DataFrame:
    """Adds ``id`` (doc_id, null as the least long) and ``key`` (digest of the text)."""
    return docs.withColumns({
        "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-2 ** 63)),
        "key": F.unhex(F.md5(clean_text(F.col("text").cast("string")).cast("binary")))})


def _coded_batches(batches: Iterator[pa.RecordBatch], code):
    for batch in batches:
        data = pa.array([code(t) for t in batch.column("text").to_pylist()], pa.binary())
        yield batch.set_column(batch.schema.get_field_index("text"), "text", data)


def covered_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, code=utf8, anchor: int = ANCHOR,
                  least_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts with any repeat, their spans): (id, key, text) and (id, key, spans array of (a, b)), both stored.

    Spans count bytes of the texts as ``code`` gives them; texts of fewer than
    ``least_bytes`` bytes (by default ``length``) are not looked at.

    Rows are told apart by doc_id (null: the least long) and text digest.  Rows
    that agree in both count as copies of each other; with ``keep_first`` both
    keep what neither has after a third.
    """
    python_workers(docs.sparkSession, 1000)
    rows = with_identity(docs).select("id", "key", clean_text(F.col("text").cast("string")).alias("text"))
    runs = saved(rows.where(F.octet_length("text") >= (least_bytes or length)).select("id", "key", "text").mapInArrow(
        lambda b: _segment_batches(b, length, code, anchor),
        "id long, key binary, value long, digest long, a long, b long, twice boolean"), "segments")
    classes = saved(runs.groupBy("value", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.max(F.col("b") - F.col("a")).alias("starts"),
        F.min(F.struct("id", "key", "a")).alias("first")), "classes")
    several = (classes.groupBy("value").agg(F.count(F.lit(1)).alias("classes"), F.max("twice").alias("any_twice"))
               .where("classes > 1 or any_twice").select("value", "classes"))
    inside = saved(classes.join(several, "value").select(
        "value", "classes", "n", "starts", "first.id", "first.key", "first.a"), "inside")
    # whole segments: all rows of a class with copies, or all but the first
    copies = classes.where("n > 1").select("value", "digest", "first")
    whole = (runs.join(copies, ["value", "digest"])
             .where(F.lit(not keep_first) | (F.struct("id", "key", "a") != F.col("first")))
             .select("id", "key", "a", (F.col("b") + length - 1).alias("b")).distinct()
             .groupBy("id", "key").agg(F.collect_list(F.struct("a", "b")).alias("whole")))
    looked = (inside.groupBy("id", "key")
              .agg(F.collect_list(F.struct("value", "classes", "n", "a", "starts")).alias("inside")))
    texts = saved(rows.join(whole.join(looked, ["id", "key"], "full"), ["id", "key"])
                  .dropDuplicates(["id", "key"]), "texts")

    coded = texts.where("inside is not null").select("id", "key", "text", "inside")
    if code is not utf8:
        schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "text" else f for f in coded.schema])
        coded = coded.mapInArrow(lambda b: _coded_batches(b, code), schema)
    piece = F.substring(F.col("text").cast("binary"), F.col("s.a").cast("int") + 1,
                        (F.col("s.starts") + length - 1).cast("int"))
    sent = (coded.select("id", "key", "text", F.explode("inside").alias("s"))
            .select("s.value", "id", "key", "s.a", F.col("s.n").alias("n"), piece.alias("piece"), "s.classes"))
    fits = F.col("classes") <= GROUP_CLASSES
    sorted_groups = (sent.where(fits).drop("classes").repartition("value")
                     .sortWithinPartitions("value", "id", "key", "a"))
    spans = sorted_groups.mapInArrow(lambda b: _block_batches(b, length, keep_first),
                                     "id long, key binary, a long, b long")
    large = sent.where(~fits).drop("classes")
    if not inside.where(~fits).isEmpty():
        windows = saved(large.mapInArrow(lambda b: _window_batches(b, length),
                                         "value long, hash long, id long, key binary, a long"), "windows")
        counted = (windows.groupBy("value", "hash")
                   .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "key", "a")).alias("first")).where("n > 1"))
        spans = spans.unionByName(
            windows.join(counted, ["value", "hash"])
            .where(F.lit(not keep_first) | (F.struct("id", "key", "a") != F.col("first")))
            .select("id", "key", "a", (F.col("a") + length).alias("b")))
    found = spans.groupBy("id", "key").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    marked = (texts.select("id", "key", "whole").join(found, ["id", "key"], "left")
              .select("id", "key", F.concat(F.coalesce("whole", F.array()), F.coalesce("found", F.array())).alias("spans"))
              .where(F.size("spans") > 0))
    return texts.select("id", "key", "text"), saved(marked, "spans")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans cut back to whole characters of UTF-8."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def _removed_batches(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ids, keys, removed, counts, digests, texts = [], [], [], [], [], []
        for i, key, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = utf8(text)
            runs = merged(spans)
            ids.append(i)
            keys.append(key)
            removed.append(sum(b - a for a, b in runs))
            counts.append(len(runs))
            digests.append(hashlib.sha256(without(data, runs)).hexdigest())
            texts.append(without(data, whole_characters(data, runs)).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(removed, pa.int64()),
             pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
            names=["id", "key", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def removals(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """One row per (id, key) that loses anything: n_removed, n_spans, kept_sha256, kept_text (whole characters)."""
    texts, spans = covered_spans(docs, length, keep_first)
    return texts.join(spans, ["id", "key"]).select("id", "key", "text", "spans").mapInArrow(
        _removed_batches, "id long, key binary, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def whole_words(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of codes as spans of the text's bytes: whole words, each with the white space behind it."""
    starts, _ = word_bounds(np.frombuffer(data, np.uint8))
    places = np.append(starts, len(data))
    out = [(int(places[-(-a // CODE)]), int(places[b // CODE])) for a, b in spans if -(-a // CODE) < b // CODE]
    return out


def _cut_batches(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ids, keys, texts = batch.column("id"), batch.column("key"), []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = utf8(text)
            texts.append(without(data, whole_words(data, merged(spans))).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([ids, keys, pa.array(texts, pa.string())], names=["id", "key", "kept_text"])


def passage_removals(docs: DataFrame, words: int, keep_first: bool = True) -> DataFrame:
    """(id, key, kept_text) of the rows that lose a word to a run of ``words`` words that also starts elsewhere.

    Words are runs without white space, compared as they are; the first copy
    (by doc_id, text digest and position) stays with ``keep_first``.  Null and
    short texts lose nothing; rows that agree in id and text count as copies.
    """
    texts, spans = covered_spans(docs, words * CODE, keep_first, word_codes, CODE_ANCHOR, 2 * words - 1)
    return texts.join(spans, ["id", "key"]).select("id", "key", "text", "spans").mapInArrow(
        _cut_batches, "id long, key binary, kept_text string")


def repeat_table(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; all copies of a repeat are removed.

    ``with_text`` adds ``text``, what is left of the text; a character that is
    removed in part stays in it, while the digest is of the bytes left.

    Null text is empty; texts shorter than ``length`` lose nothing.  Repeated
    rows are copies of each other.  Extra columns are ignored; an empty table
    gives an empty result.
    """
    lost = removals(docs, length)
    lost = saved(lost if with_text else lost.drop("kept_text"), "removals")
    text = clean_text(F.col("text").cast("string"))
    base = with_identity(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), "id", "key", F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text.cast("binary"), 256).alias("sha"), *([text.alias("text")] if with_text else []))
    none = F.lit(0).cast("long")
    return base.join(lost, ["id", "key"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *([F.coalesce("kept_text", "text").alias("text")] if with_text else []))
