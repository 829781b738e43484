"""Language identification with blended-spectrum string kernels.

A text is lower-cased, every run of characters that are not letters becomes one blank, and its n-grams of 1, 2 and 3 characters
count by presence.  For each order the kernel of two texts is the number of n-grams they share over the geometric mean of
their numbers of n-grams, counted among the n-grams that some landmark has; the blended kernel is the mean over the orders.

Landmarks are labelled texts, as many of each language.  The Nyström method maps a text to the space they span (kernel
values to the landmarks times the inverse root of the landmarks' own kernel matrix), and ridge regression of one language
against the rest is solved there.  A score is linear in the kernel values, and these are linear in presence, so the weights
fold into one matrix of n-grams by languages for each order: a batch of texts is a presence matrix, and its scores are three
matrix products.

Fitting uses a sample by hash of the id, about ``max_labels`` texts with equal quotas for the languages; all else covers every
text, whole.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every text if nothing can be learned;
texts with no n-gram of a landmark get the first learned language with score 0.5; equal scores go to the language that
sorts first; rows are judged one by one, so repeated rows and null ids give one verdict each (null ids are neither held out
nor learned from); very long texts are read whole, in one pass; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.llm.common import materialize

ORDERS = (1, 2, 3)
UNDETERMINED = "und"
BITS = 21  # a code point has 21 bits, so three fit a signed long
GROUP = 64  # texts scored together


@cache
def letter_codes() -> np.ndarray:
    """Code point to itself for letters, to the blank for all others."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.int64)


def characters(text: str | None) -> np.ndarray:
    """Code points of a text between blanks, other runs as one blank; empty if there is no letter."""
    codes = letter_codes()[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    codes = np.concatenate([[32], codes, [32]])
    blank = codes == 32
    if blank.all():
        return np.zeros(0, np.int64)
    return codes[~blank | np.concatenate([[True], ~blank[:-1]])]


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """Every n-gram of a text as a number, in order of place."""
    out = codes[: max(len(codes) - order + 1, 0)]
    for i in range(1, order):
        out = out << BITS | codes[i : len(codes) - order + 1 + i]
    return out


class Vocabulary:
    """The distinct n-grams of the landmarks, with a way to find them: distinct codes in a hash table of several layers."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.layers: list[tuple[int, np.ndarray]] = []
        left, shift = np.arange(len(codes)), 64 - max(12, int(4 * len(codes) + 1).bit_length())
        while len(left):
            slots = self._slots(codes[left], len(self.layers), shift)
            table = np.full(1 << (64 - shift), -1, np.int32)
            table[slots] = left
            self.layers.append((shift, table))
            left = left[table[slots] != left]

    @staticmethod
    def _slots(codes: np.ndarray, layer: int, shift: int) -> np.ndarray:
        odd = np.uint64((0x9E3779B97F4A7C15 + 0xBF58476D1CE4E5B9 * 2 * layer) % (1 << 64))
        return (codes.astype(np.uint64) * odd >> np.uint64(shift)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams among ``codes`` that are known, repeats included."""
        if not len(self.codes) or not len(codes):
            return np.zeros(0, np.int64)
        found = []
        for layer, (shift, table) in enumerate(self.layers):
            at = table[self._slots(codes, layer, shift)]
            hit = (at >= 0) & (self.codes[at] == codes)
            found.append(at[hit])
            codes = codes[~hit]
        return np.concatenate(found)

    def presence(self, texts: list[np.ndarray], order: int) -> np.ndarray:
        """Texts x n-grams, each row scaled to length one (or zero)."""
        out = np.zeros((len(texts), len(self.codes)), np.float32)
        for i, codes in enumerate(texts):
            out[i, self.find(grams(codes, order))] = 1
        return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))


class Landmarks:
    """Kernel values of texts to the landmarks."""

    def __init__(self, texts: list[str]):
        codes = [characters(t) for t in texts]
        self.count = len(codes)
        self.vocabularies = [Vocabulary(np.unique(np.concatenate([grams(c, n) for c in codes]))) for n in ORDERS]
        self.presences = [v.presence(codes, n) for v, n in zip(self.vocabularies, ORDERS, strict=True)]

    def kernel(self, codes: list[np.ndarray]) -> np.ndarray:
        parts = (v.presence(codes, n) @ p.T for v, n, p in zip(self.vocabularies, ORDERS, self.presences, strict=True))
        return sum(parts) / len(ORDERS)


@dataclass
class Model:
    languages: list[str]
    vocabularies: list[Vocabulary]
    weights: list[np.ndarray]  # per order: n-grams x languages

    def scores(self, codes: list[np.ndarray]) -> np.ndarray:
        return sum(v.presence(codes, n) @ w for v, n, w in zip(self.vocabularies, ORDERS, self.weights, strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; a score is the margin, cut to -1..1 and moved to 0..1."""
        names, out = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        some: list[tuple[int, np.ndarray]] = []
        for i, text in enumerate(texts):
            if len(codes := characters(text)):
                some.append((i, codes))
        for a in range(0, len(some), GROUP):
            group = some[a : a + GROUP]
            margins = self.scores([codes for _, codes in group])
            for (i, _), row in zip(group, margins, strict=True):
                best = int(np.argmax(row))
                names[i], out[i] = self.languages[best], (min(max(float(row[best]), -1.0), 1.0) + 1) / 2
        return names, out


def solve(own: np.ndarray, kernel: np.ndarray, labels: np.ndarray, classes: int, ridge: float) -> np.ndarray:
    """Landmarks x languages: coefficients of the kernel values, by Nyström features and weighted ridge regression.

    Rows weigh by the inverse of their language's number, so a frequent language does not win by its number.
    """
    values, vectors = np.linalg.eigh(own.astype(float))
    keep = values > 1e-8 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel.astype(float) @ root
    targets = np.where(labels[:, None] == np.arange(classes), 1.0, -1.0)
    weight = 1.0 / np.bincount(labels, minlength=classes)[labels]
    weight *= len(labels) / weight.sum()
    normal = features.T @ (features * weight[:, None]) + ridge * np.eye(features.shape[1])
    return root @ np.linalg.solve(normal, features.T @ (targets * weight[:, None]))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where the id's CRC32 leaves 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, max_labels: int = 4000, landmarks: int = 256, ridge: float = 1.0) -> Model | None:
    """A model from ``text`` and ``lang`` of documents that are not held out; None if there are none with a letter.

    ``max_labels`` bounds the sample (its expected size, and the rows that come to the driver), ``landmarks`` the texts that
    come to the driver.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("there")).orderBy(F.desc("there"), "of").limit(max_labels).collect()
    if not counts:
        return None
    quota = max(1, max_labels // len(counts))
    scale = 1 << 30
    shares = docs.sparkSession.createDataFrame([(r.of, min(scale, quota * scale // r.there)) for r in counts], "of string, share long")
    rank = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(scale))
    chosen = known.withColumn("rank", rank).join(F.broadcast(shares), F.col("lang") == F.col("of")).where("rank < share")  # at most max_labels languages
    sample = materialize(chosen.select("doc_id", "text", "lang", "rank"), "labelled-texts")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "doc_id", F.xxhash64("text")))
    first = sample.withColumn("place", place).where(F.col("place") <= max(1, landmarks // len(counts))).orderBy("place", "lang").limit(landmarks).collect()
    marks = Landmarks([r.text for r in first])

    def kernel_rows(batches):
        for batch in batches:
            for a in range(0, len(batch), GROUP):
                part = batch.iloc[a : a + GROUP]
                rows = marks.kernel([characters(t) for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "lang": part["lang"].to_numpy(), "kernel": list(rows.astype(float))})

    rows = sample.select("doc_id", "text", "lang").mapInPandas(kernel_rows, "doc_id long, lang string, kernel array<double>").limit(2 * max_labels).collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id, r.kernel))
    languages = sorted({r.lang for r in rows})
    labels = np.array([languages.index(r.lang) for r in rows])
    own = sum(p @ p.T for p in marks.presences) / len(ORDERS)
    fitted = solve(own, np.array([r.kernel for r in rows]), labels, len(languages), ridge)
    weights = [(p.T @ fitted / len(ORDERS)).astype(np.float32) for p in marks.presences]
    return Model(languages, marks.vocabularies, weights)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of at most ``landmarks`` texts

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if shared.value is None:
                yield pd.DataFrame({"lang_pred": [UNDETERMINED] * len(batch), "score": np.zeros(len(batch))})
                continue
            names, scores = shared.value.predict(list(batch))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.select("doc_id", held_out().alias("held_out"), run("text").alias("found")).select("doc_id", "held_out", "found.*")
