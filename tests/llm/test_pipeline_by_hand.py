"""run() of the pipeline against a plain version of its five stages on a small corpus."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_documents import one_by_one, unicode_shingles
from test_passages import kept_by_hand

WORDS = 50


def corpus(seed: int) -> tuple[list[tuple], list[tuple]]:
    """(documents, benchmark): two languages, copies, near copies, passages, leaks, letterless and null texts, repeated ids."""
    rng = random.Random(seed)
    lexicon = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(400)]
               for lang, letters in (("aa", "abcdefghij"), ("zz", "qrstuvwxyzé"))}
    prose = lambda lang, n: [rng.choice(lexicon[lang]) for _ in range(n)]
    items = [(k, " ".join(prose(rng.choice(["aa", "zz"]), rng.randint(8, 30)))) for k in range(6)]
    passage = {lang: [prose(lang, n) for n in (51, 70, 120)] for lang in lexicon}
    rows = []
    for i in range(90):
        lang = rng.choice(["aa", "zz"])
        w = prose(lang, rng.randint(30, 1500 if i % 9 == 0 else 200))
        if i % 4 == 0:
            at = rng.randint(0, len(w))
            w = w[:at] + rng.choice(passage[lang]) + w[at:]
        if i % 10 == 3:
            w = w[:20] + rng.choice(items)[1].split() + w[20:]
        rows.append((i, " ".join(w), lang))
    for i in range(90, 105):
        _, text, lang = rng.choice(rows[:60])
        w = text.split()
        if i % 2:
            w[len(w) // 2] = "changed"
        rows.append((i, " ".join(w), lang))
    rows += [(200, None, "aa"), (201, "", "aa"), (202, "12 34 -- 56", "zz"), (203, " \n ", "zz"), (5, rows[5][1], rows[5][2])]
    rng.shuffle(rows)
    return rows, items


def words_of(text: str) -> list[str]:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(lower))


def near_free(rows: list[tuple]) -> list[tuple]:
    """One row of each group of texts whose 5-word sets link at 0.8: the smallest id's."""
    rows = sorted(set(rows))
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return [r for k, r in enumerate(rows) if top(k) == k]


def pieces(rows: list[tuple], capacity: int = 1024) -> tuple[set[tuple], int]:
    """(doc_id, start, length, crc) of single-piece documents and the lengths of all; long ones are cut, the first piece may be shorter."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    short, lengths = set(), []
    for i, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        if len(ids) <= capacity:
            short.add((i, 0, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
            lengths.append(len(ids))
        else:
            lengths += [capacity] * (len(ids) // capacity) + ([len(ids) % capacity] if len(ids) % capacity else [])
    return short, lengths


def test_run_equals_the_stages_by_hand(spark, tmp_path):
    rows, items = corpus(7)
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(i, t) for i, t, _ in rows if t and re.search(r"[^\W\d_]", t)]          # language
    kept = near_free(kept)                                                          # near duplicates
    assert 60 < len(kept) < len({i for i, t, _ in rows if t})
    cut = kept_by_hand(kept, WORDS)                                                 # repeated passages
    assert sum(cut[i] != t for i, t in kept) >= 5
    kept = [(i, t) for i, t in cut.items() if t.strip()]
    leak = [unicode_shingles(t) for _, t in items]                                  # decontamination
    clean = [(i, t) for i, t in kept if not any(len(s & unicode_shingles(t)) >= 0.8 * len(s) for s in leak)]
    assert len(kept) - len(clean) >= 4
    short, lengths = pieces(clean)                                                  # packing

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == {i for i, _ in clean}
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for rs in by_doc.values() if len(rs) == 1 for r in rs} == short
    assert sorted(r["length"] for r in got) == sorted(lengths)
    assert len({r["sequence_id"] for r in got}) == one_by_one(lengths, 1024)
