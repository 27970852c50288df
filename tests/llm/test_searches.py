"""Spelling variants, exact top-k and hard negatives against brute force, and their odd cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from civiccases.llm import hard_negatives, metric_search, queries, spelling

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, row int, v string, score int"


# --- spelling variants -----------------------------------------------------------------

def counted(rows: list[tuple], erode: int = 31, least: int = 7) -> Counter:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if erode and h % erode == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += len(w) >= least
    return out


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def grouped(counts: dict[str, int], ratio: int = 10) -> set[tuple]:
    by_length = defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if one_edit(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda x: (-counts[x], x))
            if counts[best] >= ratio * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def result(df) -> list[tuple]:
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_spelling_equals_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = grouped({w: n for w, n in counted(rows).items() if n >= 2})
    got = result(spelling.spelling_table(docs))
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r[1] is not None for r in got) >= 3


@pytest.mark.parametrize("symbols", [2, 8])
def test_neighbours_of_few_letters(spark, symbols):
    """Dense neighbourhoods: words of three letters, long runs of one letter, ×, ÷ and 30-letter words."""
    rng = random.Random(symbols)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 9))): rng.randint(2, 2000) for _ in range(250)}
    words |= {"a" * k: 2 * 12 ** (k - 6) for k in range(7, 13)} | {"÷×" * 4: 2, "÷×" * 4 + "a": 20, "b" * 15 + "z" * 15: 3, "b" * 16 + "z" * 15: 31}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    got = result(spelling.variant_groups(df, symbols=symbols))
    assert len(got) == len(words) and set(got) == grouped(words)
    assert len({r[0] for r in got if r[2] == "a" * 12}) >= 4  # a chain of forms ends at its last word


def test_neighbourhood_is_whole_and_free_of_repeats():
    rng = np.random.default_rng(1)
    for length in (1, 2, 5, 9):
        words = rng.integers(0, 3, (6, length))
        rows, hashes = spelling.neighbourhood(words, 3)
        values = spelling._symbol_values(3)
        of = lambda w: int(spelling._mixed(np.array([(values[list(w)] * spelling._powers(len(w))).sum(dtype=np.uint64)
                                                     if w else np.uint64(0)]))[0])
        for k, w in enumerate(words.tolist()):
            near = {tuple(w)} | {tuple(w[:i] + w[i + 1:]) for i in range(length)}
            near |= {tuple(w[:i] + [s] + w[i + e:]) for s in range(3) for e in (0, 1) for i in range(length + 1 - e)}
            found = hashes[rows == k].tolist()
            assert sorted(found) == sorted(map(of, near))


def test_bitmap_only_saves_work(spark, docs, monkeypatch):
    words = spelling.vocabulary(spelling.words_of(docs))
    with_map = set(map(tuple, spelling.near_words(words).collect()))
    monkeypatch.setattr(spelling, "MAX_BITS", 0)
    assert with_map == set(map(tuple, spelling.near_words(words).collect())) and with_map


def test_spelling_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert set(result(spelling.spelling_table(odd_docs))) == grouped({w: n for w, n in counted(rows).items() if n >= 2})
    assert spelling.spelling_table(no_docs).count() == 0
    more = spark.createDataFrame([(None, "Abcdefgh abcdefgh ABCDEFGÀ", 1), (None, None, 2), (7, "xabcdefgh " * 60, 3)] * 2,
                                 "doc_id long, text string, word int")
    plain = {w: n for w, n in counted([(r[0], r[1]) for r in more.collect()], erode=0).items() if n >= 2}
    assert set(result(spelling.spelling_table(more, erode=0))) == grouped(plain)
    assert ("abcdefgh", "xabcdefgh", "xabcdefgh", 4, 2, 120) in grouped(plain)


# --- vectors -----------------------------------------------------------------------------

def odd_vectors(spark):
    """Nulls, non-finite and short vectors, repeated ids, rows and vectors, ties, columns that clash."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 9).astype("float32").tolist(), i % 3) for i in range(320)]
    rows += [(i, [0.5] * 9, 1) for i in range(400, 520)] + [(400, [0.5] * 9, 1), (500, [0.25] * 9, 2), (300, rows[3][1], 0)]
    rows += [(600, None, 1), (700, [math.nan] * 9, 1), (800, [math.inf] + [0.0] * 8, 1), (900, [None] + [0.1] * 8, 1),
             (1000, [0.1] * 9, None), (None, [0.5] * 9, 1), (None, [0.7] * 9, 0), (1100, [], 1), (1200, [0.9, 0.9], 2)]
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS).repartition(4)


def usable(df, scale: int, labelled: bool) -> list[tuple]:
    out = []
    for r in df.collect():
        x = r["embedding"]
        if x is not None and all(c is not None and math.isfinite(c) for c in x) and (r["label"] is not None or not labelled):
            v = [math.floor(scale * c) for c in x]
            out.append((r["vec_id"], np.array(v + [0] * (64 - len(v)), np.int64), r["label"]))
    return out


def last(i):
    return 2 ** 63 if i is None else i


def top_by_force(rows: list[tuple], top: int) -> Counter:
    out = Counter()
    for at, (q, v, _) in enumerate(rows):
        if q is not None and q % 100 == 0:
            found = sorted((-int(v @ x), last(i), k) for k, (i, x, _) in enumerate(rows) if k != at)[:top]
            out.update((q, r + 1, rows[k][0], -s) for r, (s, _, k) in enumerate(found))
    return out


def hard_by_force(rows: list[tuple], size: int, top: int) -> Counter:
    out = Counter()
    for at, (q, v, label) in enumerate(rows):
        if q is None or q % 100:
            continue
        found = sorted((-int(v @ x), last(i), k) for k, (i, x, _) in enumerate(rows) if k != at)
        same = [(-s, k) for s, _, k in found if rows[k][2] == label][:size]
        other = [(-s, k) for s, _, k in found if rows[k][2] != label]
        for p, k in same:
            inside = [(s, j) for s, j in other if 30 * p <= 100 * s <= 90 * p][:top]
            out.update((q, rows[k][0], r + 1, rows[j][0], p, s) for r, (s, j) in enumerate(inside))
    return out


TOP_COLUMNS = ["query_id", "rank", "vec_id", "score"]
HARD_COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("block", [None, 40])
def test_top_k_equals_brute_force(spark, block):
    df = odd_vectors(spark)
    got = Counter(map(tuple, metric_search.top_k(df, block=block).select(*TOP_COLUMNS).collect()))
    assert got == top_by_force(usable(df, 1024, False), 10)


def test_top_k_of_few_and_none(spark):
    three = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [-1.0, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    got = metric_search.top_k(three).select(*TOP_COLUMNS).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 512 * 1024), (0, 2, 2, -1024 * 1024)]
    assert metric_search.top_k(three.limit(0)).count() == 0 and metric_search.top_k(three.where("vec_id = 0")).count() == 0
    with pytest.raises(ArithmeticError):
        metric_search.top_k(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<float>"))


def test_tree_bounds_save_work_and_lose_nothing():
    """Clustered rows: each query equals brute force and computes few scores; radii and parent distances hold."""
    rng = np.random.default_rng(2)
    v = (rng.normal(0, 300, (40, 1, 16)) + rng.normal(0, 4, (40, 100, 16))).reshape(-1, 16).astype(np.int64)
    ids, row = np.arange(len(v)) % 1000, np.arange(len(v))
    pages = metric_search.build_pages(v, 32)
    below = {}
    for k, p in enumerate(pages):
        below[k] = p.entry if p.child[0] < 0 else np.concatenate([below[c] for c in p.child])
        assert np.allclose(metric_search.distances(v[p.entry], v[p.routing]), p.parent_distance)
        if p.child[0] >= 0:
            for e, c, radius, most in zip(p.entry, p.child, p.radius, p.most, strict=True):
                assert pages[c].routing == e and metric_search.distances(v[below[c]], v[e]).max() <= radius
                assert metric_search.squares(v[below[c]]).max() <= most
    assert sorted(below[len(pages) - 1].tolist()) == list(range(len(v)))
    computed = 0
    for q in range(0, len(v), 97):
        want = sorted((-int(v[q] @ v[x]), int(ids[x]), x) for x in range(len(v)) if x != q)[:10]
        for reach in (None, -want[-1][0], -want[3][0]):
            best, n = metric_search.search_pages(v, ids, row, pages, v[q], q, 10, reach)
            kept = [w for w in want if reach is None or -w[0] >= reach]
            assert [(s, x) for s, x in best][:len(kept)] == [(-s, x) for s, _, x in kept]
            computed += n * (reach is None)
    assert computed < 0.2 * len(v) * len(range(0, len(v), 97))


@pytest.mark.parametrize("sizes", [(1, 1, 1), (17, 64, 33), (40, 37, 90), (128, 64, 256), (5, 0, 4)])
def test_strassen_is_exact(sizes):
    rng = np.random.default_rng(sum(sizes))
    a = rng.integers(-2 ** 28, 2 ** 28, (sizes[0], sizes[1]))
    b = rng.integers(-2 ** 28, 2 ** 28, (sizes[1], sizes[2]))
    assert (hard_negatives.strassen(a, b, 4) == (a.astype(object) @ b.astype(object)).astype(np.int64)).all()


def test_heaps_merge_in_order():
    rng = np.random.default_rng(9)
    scores, allowed = rng.integers(0, 6, (7, 300)), rng.random((7, 300)) < 0.4
    heaps = hard_negatives.Heaps(7, 4)
    for j in range(0, 300, 50):
        heaps.add(0, scores[:, j:j + 50], allowed[:, j:j + 50], j)
    want = [(k, -s, p) for k in range(7) for s, p in sorted((-int(scores[k, p]), p) for p in range(300) if allowed[k, p])[:4]]
    assert list(heaps.entries()) == want


@pytest.mark.parametrize("values", [None, 300])
def test_hard_negatives_equal_brute_force(spark, values, monkeypatch):
    if values:  # blocks of 33 rows
        monkeypatch.setattr(hard_negatives, "block_rows", lambda dim: max(1, values // max(1, dim)))
    df = odd_vectors(spark)
    got = Counter(map(tuple, hard_negatives.mine(df).select(*HARD_COLUMNS).collect()))
    assert got == hard_by_force(usable(df, 256, True), 5, 10) and got
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_hard_negative_query_shifts_labels(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(i, v, (la + 1) % 10 if i % 7 == 0 else la) for i, v, la in usable(table, 256, True)]
    got = Counter(map(tuple, queries.QUERIES["op13_hard_negatives"](spark, SF).select(*HARD_COLUMNS).collect()))
    assert got == hard_by_force(rows, 5, 10)
