"""Passages by words against brute force: planted runs of 51 to 200 words, their first copy, and what stays."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from civiccases.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept_by_hand(rows: list[tuple], words: int) -> dict:
    """Texts without the words covered by a run of ``words`` words that starts earlier too (by id, then position)."""
    first, places = {}, defaultdict(list)
    split = {i: [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for i, t in rows}
    for i, _ in sorted(rows):
        w = [x[2] for x in split[i]]
        for k in range(len(w) - words + 1):
            run = tuple(w[k:k + words])
            if first.setdefault(run, (i, k)) != (i, k):
                places[i] += range(k, k + words)
    out = {}
    for i, text in rows:
        gone = set(places[i])
        starts = [x[0] for x in split[i]] + [len(text or "")]
        out[i] = (text or "")[:starts[0]] + "".join((text or "")[starts[k]:starts[k + 1]] for k in range(len(starts) - 1) if k not in gone)
    return out


def planted(seed: int) -> tuple[list[tuple], list[str]]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: [word() for _ in range(n)]
    passages = [prose(n) for n in (51, 52, 55, 60, 75, 100, 150, 200)] + [["x", "y"] * 30, ["a"] * 51]
    rows = []
    for i in range(60):
        parts = prose(rng.randint(0, 120))
        chosen = rng.sample(passages, rng.choice([0, 0, 1, 2]))
        for p, at in zip(chosen, (rng.randint(0, len(parts)), 0)):  # never one inside the other
            parts = parts[:at] + p + parts[at:]
        rows.append((i, "".join(w + rng.choice([" ", " ", "\n", "  ", "\t"]) for w in parts)))
    return rows, [" ".join(p) for p in passages]


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages_are_cut_once_and_wholly(spark, seed):
    rows, passages = planted(seed)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(4)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    want = kept_by_hand(rows, corpus_pipeline.PASSAGE_WORDS)
    assert got == {i: t for i, t in want.items() if t.strip() or t == dict(rows)[i]}
    normal = {i: f" {' '.join(t.split())} " for i, t in got.items()}
    missed = [(len(p.split()), len(p.encode()), [i for i, t in normal.items() if f" {p} " in t]) for p in passages]
    assert not [m for m in missed if len(m[2]) > 1], missed  # words, bytes and holders of what was missed
    clean = [i for i, t in rows if not any(f" {p} " in f" {' '.join(t.split())} " for p in passages)]
    assert clean and all(got[i] == dict(rows)[i] for i in clean)


def test_passages_of_the_table(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    want = kept_by_hand(rows, corpus_pipeline.PASSAGE_WORDS)
    # copies of whole rows: kept_by_hand orders by id as the stage does
    assert {i: t for i, t in got.items() if t} == {i: t for i, t in want.items() if t.strip()}


def test_query_shows_what_is_left(spark, tmp_path):
    """op5's ``text``: no planted run of 400 bytes and more is left, clean and null rows stay as they are."""
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(3, 9))) for _ in range(n))
    long, short = [prose(n) for n in (90, 120, 200)], [prose(n)[:200] for n in (52, 60)]
    assert all(len(p.encode()) >= 400 for p in long) and all(len(p.encode()) < 400 for p in short)
    rows = [(i, f"{prose(30)}|{p}|{prose(30)}") for i, p in enumerate([*long, *long, *short, *short, "", ""])]
    rows += [(50, None), (51, ""), (51, ""), (None, "é" * 900), (52, prose(500))]
    (spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
     .write.parquet(str(tmp_path / "documents.parquet")))
    found = queries.op5_repeated_passages(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    got = defaultdict(list)
    for r in found.collect():
        got[r["doc_id"]].append((r["n_removed"], r["text"]))
        assert r["n_bytes"] - r["n_removed"] == len(r["text"].encode())
        assert r["kept_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    assert sum(map(len, got.values())) == len(rows) and got[51] == [(0, ""), (0, "")] and got[None] == [(1800, "")]
    for i, t in rows:
        cut = [p for p in long if i is not None and p in (t or "")]
        if cut:  # the bars beside it are part of both copies
            assert got[i] == [(len(cut[0].encode()) + 2, t.replace(f"|{cut[0]}|", ""))]
        elif i not in (None, 51):
            assert got[i] == [(0, t or "")]


def test_query_leaves_a_character_cut_in_part(spark):
    shared = "xyz" * 3 + "".join(chr(0x3400 + k) for k in range(200))  # ends of the run share the first byte of a character
    docs = spark.createDataFrame([(1, "a" + shared + "\u00e9"), (2, "b" + shared + "\u00ea")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.repeat_table(docs, with_text=True).collect()}
    assert {i: (r["n_removed"], r["text"]) for i, r in got.items()} == {1: (610, "aé"), 2: (610, "bê")}
    assert got[1]["kept_sha256"] == hashlib.sha256(b"a\xa9").hexdigest()


def test_word_codes_follow_words_alone(monkeypatch):
    rng = random.Random(3)
    words = ["a", "bb", "ccc", "é", "日本", "x" * 300]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n\n", "\x0b"]) for _ in range(50)) for _ in range(20)]
    plain = [suffix_dedup.word_codes(t) for t in texts]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    codes = {}
    for t, whole in zip(texts, plain, strict=True):
        assert suffix_dedup.word_codes(t) == whole and len(whole) == 4 * len(t.split())
        for w, c in zip(t.split(), np.frombuffer(whole, "<u4").tolist(), strict=True):
            assert codes.setdefault(w, c) == c
    assert len(set(codes.values())) == len(words)
    assert suffix_dedup.word_codes("") == suffix_dedup.word_codes(" \n") == b""


def test_a_block_of_segments_takes_little_memory():
    """A task's workspace while it sorts segments, in MB; the spans are those of the planted copies."""
    rng = np.random.default_rng(4)
    n, size, length = 6000, 570, 400
    pieces = [rng.integers(97, 123, size, dtype=np.uint8).tobytes() for _ in range(n)]
    for k in range(0, n, 40):  # a window of the next one, in the same group
        pieces[k + 1] = pieces[k][100:100 + length] + b"-" + pieces[k + 1][length + 1:]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n) // 4), pa.array(np.arange(n)), pa.array([b"k"] * n), pa.array(np.zeros(n, np.int64)),
         pa.array(np.ones(n, np.int64)), pa.array(pieces)], names=["value", "id", "key", "a", "n", "piece"])
    tracemalloc.start()
    found = [r for out in suffix_dedup._block_batches(iter([batch.slice(k, 1000) for k in range(0, n, 1000)]), length, False)
             for r in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert sorted((r["id"], r["a"], r["b"]) for r in found) == sorted(
        x for k in range(0, n, 40) for x in ((k, 100, 500), (k + 1, 0, 400)))
    assert peak < 100, peak
