"""Language identification with a string kernel.

Kernel: blended spectrum of character n-grams (n = 1..3), presence only - the
number of distinct n-grams that two texts share, divided by the root of the
product of their own numbers.  Nystroem landmarks turn it into an explicit
feature space, in which one-versus-rest kernel ridge regression is solved in
closed form.  Whole texts are scored in Arrow batches by matrix products.

Fitting uses a bounded sample: ``per_lang`` rows of each language, taken by the
order of a hash of the doc_id, of all languages.  Letters of all scripts are told
apart.  Everything else covers all rows.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiccases.llm.common import python_workers

#: bounds of the fit: rows a language, landmarks a language
PER_LANG = 500
LANDMARKS = 32
RIDGE = 1e-3
#: a text is about chance if its margin is under this share of what training rows of the least clear language have
CHANCE = 0.04
#: or if it knows under this share of the runs of three that such rows know (rows that are no landmarks)
KNOWN_PART = 0.5
UNDETERMINED = "und"

#: n-grams are code points of 21 bits each, the last one lowest; OTHER stands for all that is no letter
BITS, OTHER = 21, 1
#: texts of one matrix product
BLOCK = 128
#: landmarks of one matrix product; its columns are the n-grams of these landmarks only
CHUNK = 128


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """Code point -> itself for letters, OTHER for all else."""
    return np.array([i if chr(i).isalpha() else OTHER for i in range(sys.maxunicode + 1)], np.int64)


def grams(text: str) -> np.ndarray:
    """Distinct n-grams of a whole text, in order, empty if it has no letter."""
    code = letter_codes()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    if not (code > OTHER).any():
        return np.empty(0, np.int64)
    code = np.concatenate(([OTHER], code, [OTHER]))
    pair = (code[:-1] << BITS) | code[1:]
    threes = np.unique((pair[:-1] << BITS) | code[2:])
    pairs = np.unique(np.append(threes >> BITS, pair[-1]))  # all but the last pair begin a run of three
    ones = np.unique(pairs >> BITS)
    blank = [OTHER, OTHER << BITS | OTHER, (OTHER << BITS | OTHER) << BITS | OTHER]
    found = np.concatenate((ones, pairs, threes))
    return found[~np.isin(found, blank)]


def _columns(vocabulary: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Places in the ordered ``vocabulary`` of those n-grams that it holds."""
    at = np.searchsorted(vocabulary, own)
    at[at == len(vocabulary)] = 0
    return at[vocabulary[at] == own]


class Landmarks:
    """A chunk of landmark texts: presence of their n-grams, divided by their norms."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        self.vocabulary = np.unique(np.concatenate(texts))
        self.matrix = self.presence(texts)

    def presence(self, texts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        for i, own in enumerate(texts):
            out[i, _columns(self.vocabulary, own)] = 1 / np.sqrt(max(len(own), 1))
        return out


def kernel(chunks: list[Landmarks], texts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([c.presence(texts) @ c.matrix.T for c in chunks], axis=1).astype(np.float64)


@dataclass
class KernelModel:
    langs: list[str]
    vocabulary: np.ndarray  # n-grams of the landmarks, in order
    weights: np.ndarray     # n-grams x langs: landmarks times the weights of the regression
    bias: np.ndarray
    cutoff: float = 0.0     # margin under which a text is about chance
    least_known: float = 0.0  # share of known runs of three under which it is

    def outputs(self, own: np.ndarray) -> np.ndarray:
        found = _columns(self.vocabulary, own)
        return self.bias + self.weights[found].sum(axis=0, dtype=np.float64) / np.sqrt(max(len(own), 1))

    def margin(self, own: np.ndarray, out: np.ndarray) -> float:
        """The best output over the mean of all; 0 for a text without any n-gram of the landmarks."""
        return out.max() - out.mean() if len(_columns(self.vocabulary, own)) else 0.0

    def known_share(self, own: np.ndarray) -> float:
        """The share of a text's distinct runs of three that landmarks have; every text with a letter has such runs."""
        threes = own[own >> 2 * BITS > 0]
        return len(_columns(self.vocabulary, threes)) / len(threes)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (the best class's share of the positive outputs) and whether it is clear, of each text.

        Clear: above chance.  With less than two learned languages nothing can
        be told apart, and every text with a letter is clear.
        """
        langs, scores, clear = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            own = grams(text or "")
            clear[i] = len(own) > 0
            if not self.langs or not len(own):
                langs.append(UNDETERMINED)
                continue
            out = self.outputs(own)
            langs.append(self.langs[out.argmax()])
            share = np.clip(out, 0, None)
            scores[i] = np.clip(share.max() / max(share.sum(), 1e-9), 0, 1)
            clear[i] = len(self.langs) < 2 or (self.margin(own, out) >= self.cutoff
                                               and self.known_share(own) >= self.least_known)
        return langs, scores, clear


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """Fit on (lang, text) rows; the first ``landmarks`` rows of each language become landmarks.

    Memory goes with landmarks x landmarks and n-grams x languages; the rows'
    kernels are summed up block by block.
    """
    codes = letter_codes()
    kept = [(lang, text) for lang, text in rows
            if (codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")] > OTHER).any()]
    own = Counter(lang for lang, _ in kept)
    langs = sorted(own)
    if not langs:
        return KernelModel([], np.empty(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0))
    first = {lang: [t for k, t in kept if k == lang][:landmarks] for lang in langs}
    chosen = [grams(t) for lang in langs for t in first[lang]]
    chunks = [Landmarks(chosen[at:at + CHUNK]) for at in range(0, len(chosen), CHUNK)]
    k_mm = np.concatenate([kernel(chunks, chosen[at:at + BLOCK]) for at in range(0, len(chosen), BLOCK)])
    # every language weighs the same, however many rows it has
    place = {lang: j for j, lang in enumerate(langs)}
    k_kk, k_y = np.zeros_like(k_mm), np.zeros((len(chosen), len(langs)))
    for at in range(0, len(kept), BLOCK):
        block = kept[at:at + BLOCK]
        k = kernel(chunks, [grams(t) for _, t in block])
        y = np.zeros((len(block), len(langs)))
        y[np.arange(len(block)), [place[lang] for lang, _ in block]] = 1
        weight = np.array([1 / (own[lang] * len(langs)) for lang, _ in block])  # 1 in all
        k_kk += (k * weight[:, None]).T @ k
        k_y += (k * weight[:, None]).T @ y
    k_mean, y_mean = k_y.sum(axis=1), np.full(len(langs), 1 / len(langs))
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    use = values > 1e-6 * values.max()
    to_features = vectors[:, use] / np.sqrt(values[use])
    z_z = to_features.T @ (k_kk - np.outer(k_mean, k_mean)) @ to_features
    z_y = to_features.T @ (k_y - np.outer(k_mean, y_mean))
    weights = to_features @ np.linalg.solve(z_z + ridge * np.eye(len(z_z)), z_y)
    vocabulary = np.unique(np.concatenate([c.vocabulary for c in chunks]))
    by_gram = np.zeros((len(vocabulary), len(langs)), np.float32)
    for j, c in enumerate(chunks):
        by_gram[np.searchsorted(vocabulary, c.vocabulary)] += c.matrix.T @ weights[j * CHUNK:(j + 1) * CHUNK].astype(np.float32)
    model = KernelModel(langs, vocabulary, by_gram, y_mean - k_mean @ weights)
    margins, known = {lang: [] for lang in langs}, {lang: [] for lang in langs}
    for lang, text in kept:
        g = grams(text)
        if len(margins[lang]) >= landmarks:
            known[lang].append(model.known_share(g))
        margins[lang].append(model.margin(g, model.outputs(g)))
    model.cutoff = CHANCE * min(float(np.median(x)) for x in margins.values())
    # a language of which all rows are landmarks cannot tell how much an unseen text knows
    model.least_known = KNOWN_PART * min(float(np.median(x)) if x else 0.0 for x in known.values())
    return model


def held_out() -> Column:
    """crc32 of the doc_id as text, modulo 5, is 0; false without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """At most ``per_lang`` (lang, text) rows of each language, in hash order."""
    labelled = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return []
    # a share of the hash range that holds about 1.5 times the bound, then the exact bound
    span = 1 << 40
    share = F.create_map(*[F.lit(x) for lang, n in counts.items()
                           for x in (lang, int(span * min(1.0, 1.5 * per_lang / n + 1e-9)))])
    near = (labelled.withColumn("_h", F.xxhash64("doc_id"))
            .where(F.pmod("_h", F.lit(span)) < share[F.col("lang")])
            .dropDuplicates(["lang", "_h"]))
    order = Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(span)), "_h")
    rows = (near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_lang)
            .orderBy("lang", "_k").select("lang", "text").collect())
    return [(r[0], r[1]) for r in rows]


def _predict_batches(batches: Iterator[pa.RecordBatch], model: KernelModel):
    for batch in batches:
        last = batch.num_columns - 1
        langs, scores, clear = model.predict(batch.column(last).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:last], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(clear)],
            names=[*batch.schema.names[:last], "lang_pred", "score", "clear"])


def identify(docs: DataFrame, model: KernelModel, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with lang_pred, score and clear (above chance) of every row's whole text.

    ``und`` with score 0 for null, empty and letterless texts.  Repeated rows
    are scored each.  Nothing but the text enters a prediction.
    """
    python_workers(docs.sparkSession, 1000)
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(lambda batches: _predict_batches(batches, shared.value),
                           f"{fields}, lang_pred string, score double, clear boolean")


def language_table(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out; predict every row: doc_id, held_out, lang_pred, score."""
    model = fit(training_rows(docs))
    flagged = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(flagged, model, ["doc_id", "held_out"]).drop("clear")
