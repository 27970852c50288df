"""Operators on documents against brute force, and their odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civiccases.llm import decontaminate, fingerprints, jaccard_join, language_id, licenses, packing, suffix_dedup
from civiccases.llm.common import clean_text

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def texts_of(df) -> list[tuple]:
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# --- packing ------------------------------------------------------------------------

def test_word_encoder_equals_tokenizer():
    encode, whole = packing.WordEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "1", "é", "!", "don't", "\x1c", "\0", "<|endoftext|>", "日本",
             "\r\n", " ", "ß9", "%%%", "x. ", "…"]
    for _ in range(4000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert encode(s) == np.asarray(whole.encode(s, add_special_tokens=False).ids, "<u4").tobytes(), repr(s)


def one_by_one(lengths: list[int], capacity: int) -> int:
    """Bins of best-fit decreasing, one piece at a time."""
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        room = [r for r in bins if r >= n]
        if room:
            bins[bins.index(min(room))] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_plan_equals_sequential(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, rng.choice([5, 30, 64])) for _ in range(rng.randint(1, 300))]
    plan = packing.best_fit_plan(Counter(lengths), 64)
    assert len({t for t in check_plan(plan, Counter(lengths), 64)}) == one_by_one(lengths, 64)


def check_plan(plan, counts, capacity):
    """The bins used, after checking that every rank is placed once and bins have no gap or overlap."""
    bins = defaultdict(list)
    for length, n in counts.items():
        rows = sorted(r for r in plan.tolist() if r[0] == length)
        for k, (_, first, bin0, each, offset) in enumerate(rows):
            last = rows[k + 1][1] if k + 1 < len(rows) else n
            for rank in range(first, last):
                bins[bin0 + (rank - first) // each].append((offset + (rank - first) % each * length, length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(map(len, bins.values())) == sum(counts.values())
    return bins


def test_packed_rows(docs, odd_docs):
    whole = Tokenizer.from_file(TOKENIZER)
    for df in (docs, odd_docs):
        rows = packing.pack_documents(df, TOKENIZER).collect()
        found = defaultdict(Counter)
        for r in rows:
            found[r["doc_id"]][(r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
        expected = defaultdict(Counter)
        for i, t in texts_of(df):
            ids = [*whole.encode(t, add_special_tokens=False).ids, 2]
            for k, (s, n) in enumerate(packing.cut(len(ids))):
                expected[i][(k, s, n, zlib.crc32(np.asarray(ids[s:s + n], "<u4").tobytes()))] += 1
        assert found == expected
        sequences = defaultdict(list)
        for r in rows:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for pieces in sequences.values():
            assert sum(n for _, n in pieces) <= 1024
            assert sorted(o for o, _ in pieces) == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))]
        assert len(sequences) == one_by_one([r["length"] for r in rows], 1024)


def test_packing_nothing(no_docs):
    assert packing.pack_documents(no_docs, TOKENIZER).count() == 0


# --- Jaccard join ---------------------------------------------------------------------

def shingles(text: str) -> set:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows: list[tuple]) -> dict:
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for k, (i, s) in enumerate(sets):
        for other, n in Counter(o for x in s for o in holders[x] if o < k).items():
            j, t = sets[other]
            if 100 * n >= 80 * (len(s) + len(t) - n):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(s), top(i)) for i, s in sets}


def test_components_equal_brute_force(docs, odd_docs):
    for df in (docs, odd_docs.where("doc_id is not null")):
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"])
                 for r in jaccard_join.linked_documents(df).collect()}
        assert found == brute_components(texts_of(df))


def test_components_of_edited_copies(spark):
    """A hot group: copies of one text with different numbers of edits, some too many to link."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        own = list(words)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = f"e{rng.random()}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked_documents(df).collect()}
    assert found == brute_components(rows)


def test_join_odd_rows(odd_docs, no_docs):
    rows = jaccard_join.linked_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert jaccard_join.linked_documents(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_t_occurrence(seed):
    rng = random.Random(seed)
    lists = [sorted(rng.sample(range(40), rng.randint(0, 30))) for _ in range(rng.randint(1, 25))]
    counts = Counter(x for one in lists for x in one)
    needed = {k: rng.randint(1, 14) for k in rng.sample(range(40), 25)}
    found = jaccard_join.t_occurrence(lists, dict.fromkeys(range(40), 99) | needed)
    least = min(needed.values())
    assert {k: v for k, v in found.items() if k in needed} == {
        k: counts[k] for k, t in needed.items() if counts[k] >= max(t, least)}


# --- repeated passages ------------------------------------------------------------------

def brute_repeats(rows: list[tuple], length: int, keep_first: bool = False) -> list[tuple]:
    seen = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        for s in range(len(t) - length + 1):
            seen[t[s:s + length]].append((k, s))
    covered = [bytearray(len(t)) for _, t in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, s in places[1:] if keep_first else places:
                covered[k][s:s + length] = b"\1" * length
    out = []
    for (i, t), c in zip(rows, covered, strict=True):
        kept = bytes(b for b, x in zip(t, c, strict=True) if not x)
        runs = sum(1 for k in range(len(c)) if c[k] and (k == 0 or not c[k - 1]))
        out.append((i, len(t), sum(c), runs, hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("group", [3000, 0])
def test_repeats_equal_brute_force(docs, odd_docs, no_docs, monkeypatch, group):
    """With groups sorted in blocks, and with all of them counted by window."""
    monkeypatch.setattr(suffix_dedup, "GROUP_CLASSES", group)
    for df, length in ((docs, 400), (odd_docs, 400)):
        rows = [(i, t.encode()) for i, t in texts_of(df)]
        if df is odd_docs:
            rows = [r for r in rows if len(r[1]) < 50_000]
            df = df.where("text is null or length(text) < 50000")
        found = [tuple(r) for r in suffix_dedup.repeat_table(df, length).collect()]
        assert order(found) == order(brute_repeats(rows, length))
    assert suffix_dedup.repeat_table(no_docs).count() == 0


def test_repeats_keep_first(docs):
    rows = sorted((i, t.encode()) for i, t in texts_of(docs))
    found = {r["id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"])
             for r in suffix_dedup.removals(docs, keep_first=True).collect()}
    for i, _, n, runs, sha in brute_repeats(rows, 400, True):
        assert found.get(i, (0, 0, sha)) == (n, runs, sha)


def test_periodic_text_repeats_within_itself(spark):
    text = "ab" * 5000
    row = suffix_dedup.repeat_table(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (10_000, 10_000, 1)


def test_spans_are_cut_to_characters():
    data = "aéb".encode()
    assert suffix_dedup.whole_characters(data, [(2, 4)]) == [(3, 4)]
    assert suffix_dedup.whole_characters(data, [(0, 2)]) == [(0, 1)]


# --- fingerprints -------------------------------------------------------------------------

def test_fingerprints(docs, odd_docs, no_docs):
    for df in (docs, odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted(texts_of(df), reverse=True)
        found = {r["doc_id"]: r for r in fingerprints.fingerprint_table(df).collect()}
        by_text, errors = {}, []
        for k, (i, t) in enumerate(rows):
            nxt = rows[(k + 1) % len(rows)][1]
            half = len(t) // 2
            edited = t[:len(t) - half] + nxt[:half]
            r = found[i]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
            a, b = unicode_shingles(t), unicode_shingles(edited)
            errors.append(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
    assert fingerprints.fingerprint_table(odd_docs).count() == odd_docs.count()
    assert fingerprints.fingerprint_table(no_docs).count() == 0


def unicode_shingles(text: str) -> set:
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_short_texts_have_their_own_fingerprints(spark):
    """A text of one shingle lends one value to all bins, and still every bin is a trial of its own."""
    rows = [(i, f"first{i} second{i * 7}") for i in range(400)]
    found = fingerprints.fingerprint_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["fingerprint"] for r in found}) == 400 and max(r["near_next"] for r in found) <= 0.3
    assert all(r["near_edited"] <= 1 for r in found)


def test_neighbours_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 10)
    ids = random.Random(5).sample(range(100_000), 237)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    found = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(df, ["text"]).collect()}
    down = sorted(ids, reverse=True)
    assert found == {i: f"t{down[(k + 1) % len(down)]}" for k, i in enumerate(down)}


# --- decontamination --------------------------------------------------------------------

def test_leaks_equal_brute_force(spark, docs, odd_docs, no_docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r["item_id"]: unicode_shingles(r["text"]) for r in bench.collect()}
    expected = set()
    for i, t in texts_of(docs):
        own = unicode_shingles(t)
        expected |= {(i, j) for j, s in items.items() if len(s & own) >= 0.8 * len(s)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()} == expected
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "word1 word2 word3 word4 word5 word6")],
                                "item_id long, text string")
    pairs = [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(odd_docs, odd).collect()]
    assert len(pairs) == len(set(pairs))
    assert {p for p in pairs if p[1] == 3} == {(6, 3), (7, 3)}
    assert {p[0] for p in pairs if p[1] is None} == {1, 2, 10, None}
    assert decontaminate.find_leaks(no_docs, bench).count() == 0
    assert decontaminate.find_leaks(docs, odd.limit(0)).count() == 0
    clean = decontaminate.decontaminate(odd_docs, odd)
    assert clean.columns == odd_docs.columns and clean.where("doc_id in (1, 2, 6, 7, 10)").count() == 0


def test_rows_that_share_an_id_are_judged_alone(spark):
    """Five shingles of an item in one row and six in another are no leak; a leak takes no other row with it."""
    w = [f"w{k}" for k in range(24)]
    item = " ".join(w[:18])
    rows = [(None, " ".join(w[:9])), (None, " ".join(w[8:18])), (None, "x " + item), (1, " ".join(w[:9])), (1, " ".join(w[8:18])), (2, item),
            (2, "clean words and nothing of the kind"), (2, item), (None, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item int").repartition(3)
    bench = spark.createDataFrame([(7, item), (7, item), (7, "another item of seven words it is")], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["item_id"], r["item_shingles"]) for r in decontaminate.find_leaks(df, bench).collect()) == [(0, 7, 14), (2, 7, 14)]
    left = decontaminate.decontaminate(df, bench)
    assert left.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(r for r in rows if item not in (r[1] or ""))


def test_sketches_find_what_the_whole_join_finds(spark, docs):
    """Recall of the candidates is 1 against the exact join, and they are a small share of the pairs that share a shingle."""
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for threshold in (0.5, 0.8, 1.0):
        items = decontaminate.item_shingles(bench, threshold).persist()
        known = decontaminate.with_identity(docs.select("doc_id", "text"), "doc_id")
        got = {(r["id"], r["item"]) for r in decontaminate.candidates(known, items).collect()}
        exact = (known.select("id", F.explode(F.array_distinct(decontaminate._shingles(clean_text("text"), 5))).alias("h"))
                 .join(items, "h").groupBy("id", "item", "q").count().collect())
        leaks = {(r["id"], r["item"]) for r in exact if r["count"] >= threshold * r["q"]}
        assert leaks <= got <= {(r["id"], r["item"]) for r in exact} and (leaks or threshold == 1.0)


def test_the_sketch_join_comes_first(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = decontaminate.item_shingles(bench)
    plan = decontaminate.candidates(decontaminate.with_identity(docs, "doc_id"), items)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line or "Scan parquet" in line]
    assert len(scans) == 2 and any("sketch" in x for x in scans) and "SortMergeJoin" not in plan


# --- language --------------------------------------------------------------------------

def test_language_accuracy(docs, odd_docs, no_docs):
    rows = language_id.language_table(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if r["held_out"]}
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    odd = language_id.language_table(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (3, 4, 5, 8)} == {"und"}
    assert language_id.language_table(no_docs).count() == 0
    assert {r["lang_pred"] for r in language_id.language_table(docs.withColumn("lang", docs["lang"].substr(9, 1))
                                                               .replace("", None, ["lang"])).collect()} == {"und"}


def test_every_script_and_language_is_learned():
    """Han, Hebrew, Greek, Thai and supplementary letters beside Latin and Cyrillic; 70 languages."""
    rng = random.Random(3)
    starts = {"la": 0x61, "ru": 0x430, "el": 0x3B1, "he": 0x5D0, "ar": 0x627, "th": 0xE01, "zh": 0x4E00, "ja": 0x3042,
              "ko": 0xAC00, "am": 0x1200, "got": 0x10330}
    def text(start: int, size: int) -> str:
        return " ".join("".join(chr(start + rng.randrange(size)) for _ in range(4)) for _ in range(12))

    model = language_id.fit([(k, text(at, 20)) for k, at in starts.items() for _ in range(20)])
    assert model.langs == sorted(starts)
    for k, at in starts.items():
        assert model.predict([text(at, 20) for _ in range(5)])[0] == [k] * 5, k
    many = {f"l{j:02}": 0x4E00 + 30 * j for j in range(70)}
    model = language_id.fit([(k, text(at, 30)) for k, at in many.items() for _ in range(8)])
    assert [model.predict([text(at, 30)])[0] for at in many.values()] == [[k] for k in many]
    plain = {c for n in (1, 2, 3) for w in [" aß1b "] for i in range(len(w) - n + 1) if (c := w[i:i + n].replace("1", " ")).strip()}
    assert len(language_id.grams("aß1b")) == len(plain)


# --- licences ---------------------------------------------------------------------------

def test_license_forms(spark, odd_docs, no_docs):
    mit = dict(licenses.KNOWN)["MIT"]
    noisy = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ;").replace("\n", "  \n")
    rows = [(1, noisy), (2, "text\nReleased under the MIT Licence!\nmore"), (3, "Released under the MIT"), (4, None),
            (5, "all RIGHTS reserved"), (5, "all RIGHTS reserved")]
    found = Counter((r["doc_id"], r["unit"], r["line"], r["license_id"]) for r in licenses.license_table(
        spark.createDataFrame(rows, "doc_id long, text string")).collect())
    reserved = "LicenseRef-all-rights-reserved"
    assert found == {(1, "text", None, "MIT"): 1, (2, "line", 2, "MIT"): 1,
                     (5, "text", None, reserved): 2, (5, "line", 1, reserved): 2}
    assert licenses.license_table(odd_docs).count() == 0
    assert licenses.license_table(no_docs).count() == 0


def test_whole_licenses_and_copyright_lines(spark):
    """Whole files of common licences, titled texts, and what follows a copyright statement."""
    mit, own = dict(licenses.KNOWN)["MIT"], "Copyright (c) 2020 J. Smith"
    read = {name: (licenses.TEXTS / f"{name}.txt").read_text() for name in licenses.FILES}
    gpl, bsd = read["GPL-3"], read["BSD-2-Clause"]
    whole = [(lic, read[name]) for name, (lic, _) in licenses.FILES.items()]
    whole += [("MIT", f"MIT License\n\n{own}\n\n{mit}"), ("GPL-3.0", gpl[gpl.index("Everyone"):gpl.index("END OF")]),
              ("GPL-3.0", gpl.replace("https", "http")),
              ("Apache-2.0", read["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 J. Smith")),
              ("BSD-3-Clause", "BSD 3-Clause License\n" + bsd.replace("THIS SOFTWARE IS", licenses._CLAUSE_3 + "THIS SOFTWARE IS"))]
    lines = [("LicenseRef-all-rights-reserved", f"x\n{own}. All rights reserved."), ("MIT", "x\n© Me, released under the MIT license"),
             ("MIT", f"x\n{own} {' '.join(mit.split())}"), ("Apache-2.0", "x\n// SPDX-License-Identifier: Apache-2.0")]
    rows = [(k, t) for k, (_, t) in enumerate(whole + lines)] + [(99, own), (98, "x\ue000\ny")]
    got = {(r["doc_id"], r["unit"], r["license_id"]) for r in licenses.license_table(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(k, "text", lic) for k, (lic, _) in enumerate(whole)} == {g for g in got if g[1] == "text"}
    assert {(len(whole) + k, "line", lic) for k, (lic, _) in enumerate(lines)} <= got
    assert not {g for g in got if g[0] in (98, 99)}
    own_table = licenses.license_table(spark.createDataFrame([(1, "My terms.")], "doc_id long, text string"), [("Mine", "my TERMS")])
    assert {r["license_id"] for r in own_table.collect()} == {"Mine"}
