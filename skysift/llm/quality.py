"""Quality rules: boosted trees over document statistics, behind two hard rules.

Statistics come from one pass of numpy-assisted Python inside Arrow batches, without a shuffle.  The trees are trained on a
bounded sample of labelled rows (``max_labels``) and shipped as flat node arrays.  More symbols, repeated lines or repeated
windows can only lower a score (monotone constraints).

Defined results: a null text is the empty text (no words, so the first hard rule rejects it); rows are judged one by one,
so repeated rows and null ids give one verdict each; without usable labels the hard rules decide alone; extra columns of
any name are kept by ``keep_good`` and ignored by ``judge``.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.common import BLANKS, texts, utf8
from skysift.llm.trees import Forest, train

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "lines_per_word",
    "digit_share", "upper_share", "stop_share", "pipe_share", "wide_share",
)
#: Feature number to direction: the score never rises with these.
MONOTONE = {FEATURES.index(name): -1 for name in ("symbols_per_word", "dup_line_share", "repeat_share", "pipe_share")}
ROW = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


@dataclass(frozen=True)
class Model:
    forest: Forest
    threshold: float
    held_out: dict


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    again = np.fromiter((seen[x] > 1 for x in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def statistics(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    raw = utf8(text)
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    some, letters = max(n, 1), max(chars, 1)
    codes = np.frombuffer(raw, np.uint8)
    counts = np.bincount(codes, minlength=256) if len(codes) else np.zeros(256, np.int64)
    features = (
        np.log1p(n), chars / some, symbols / some, dup_lines / max(len(lines), 1), repeats / some, len(set(words)) / some,
        len(lines) / some, counts[48:58].sum() / letters, counts[65:91].sum() / letters, counts[46] / some, counts[124] / some,
        counts[192:].sum() / letters,
    )
    return (n, chars, symbols, dup_lines, repeats), features


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > 50 * n_words


def _judge(batch: pd.Series, model: Model | None) -> pd.DataFrame:
    found = [statistics(t if t is not None else "") for t in batch]
    out = pd.DataFrame([s for s, _ in found], columns=list(STATS), dtype="int64")
    out["base_failed"] = [base_failed(s[0], s[4]) for s, _ in found]
    score = np.ones(len(out))
    if model is not None and len(out):
        score = model.forest.probability(np.array([f for _, f in found], float))
    out["kept"] = ~out["base_failed"].astype(bool) & (score >= (model.threshold if model is not None else 0.0))
    out["score"] = score
    return out


def judging(model: Model | None):
    """A vectorised column function: text to statistics, hard-rule outcome, verdict and score."""

    @F.pandas_udf(ROW)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _judge(batch, model)

    return run


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000) -> Model | None:
    """Train on at most ``max_labels`` labelled documents, chosen by the hash of their id.

    The label of an id that is labelled several times is the majority (a tie counts as good).  A fifth of the sample is held
    out; the threshold is one half, or lower if that would lose over 0.5 % of the held-out good documents.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("quality"))
    )
    there = chosen.count()
    if not there:
        return None
    scale = 1 << 20
    share = min(scale, int(scale * max_labels / there))
    sample = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share).limit(max_labels)

    def features(batches):
        for batch in batches:
            yield batch[["doc_id", "quality"]].assign(features=[list(map(float, statistics(t)[1])) for t in batch["text"]])

    rows = (
        texts(docs)
        .join(F.broadcast(sample), "doc_id")  # at most max_labels ids
        .mapInPandas(features, "doc_id long, quality double, features array<double>")
        .orderBy("doc_id")
        .collect()
    )
    if not rows:
        return None
    x = np.array([r.features for r in rows])
    y = np.array([r.quality >= 0.5 for r in rows], float)
    held = np.array([(r.doc_id * 2654435761 >> 7) % 5 == 0 for r in rows])
    if held.all() or not held.any():
        held = np.arange(len(rows)) % 5 == 4
    forest = train(x[~held], y[~held], MONOTONE) if (~held).any() else train(x, y, MONOTONE)
    score, good = forest.probability(x[held]) if held.any() else np.ones(0), y[held] > 0
    threshold = min(0.5, float(np.quantile(score[good], 0.005))) if good.any() else 0.5
    report = {
        "labelled": len(rows),
        "held_out": int(held.sum()),
        "good_kept": float((score[good] >= threshold).mean()) if good.any() else None,
        "bad_rejected": float((score[~good] < threshold).mean()) if (~good).any() else None,
    }
    return Model(forest, threshold, report)


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: ``doc_id``, statistics, ``base_failed``, ``kept``, ``score``."""
    return texts(docs).select("doc_id", judging(model)("text").alias("judged")).select("doc_id", "judged.*")


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return docs.where(judging(model)("text")["kept"])


def fit_tables(spark: SparkSession, folder: str, docs: DataFrame) -> Model | None:
    return fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
