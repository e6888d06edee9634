"""A quality classifier by pairwise ranking (Bradley-Terry).

P(a is better than b) = sigmoid(w . (x_a - x_b)). The weights are learnt by logistic loss on the feature
differences of preference pairs: a document labelled good is preferred to one labelled bad. The raw score
w . x is then placed so that the threshold lies at the score quantile that the labels call for.

The features are figures of a text's own characters, words and lines, computed by DataFrame functions;
the weights, a few dozen numbers, are all that reaches the scoring pass. Fitting takes a sample of at most
LABELLED rows, so its cost has a bound whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import let, text_of, words_of

#: Most labelled rows that the fit takes (those of least hash), and pairs made of them.
LABELLED, PAIRS = 20_000, 100_000
#: Documents at or above this score are predicted good.
THRESHOLD = 0.3
RIDGE, STEPS, SEED = 1e-3, 30, 7


def _kept(text: Column, characters: str) -> Column:
    """How many characters of the text are in a regular-expression class."""
    return F.char_length(F.regexp_replace(text, f"[^{characters}]+", ""))


def features(text: Column) -> Column:
    """array<double> of figures of a text that hardly depend on its length."""

    def of_words(words: Column) -> Column:
        n = F.greatest(F.size(words), F.lit(1))
        chars = F.char_length(F.array_join(words, ""))
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
        distinct = F.size(F.array_distinct(words))
        return F.array(
            F.log1p(F.size(words)),
            chars / n,
            distinct / n,
            distinct / F.sqrt(n),
            F.aggregate(pairs, F.lit(0), lambda total, same: total + same) / n,
        )

    def of_lines(lines: Column) -> Column:
        n = F.size(lines)
        return F.array((n - F.size(F.array_distinct(lines))) / n, n / F.greatest(F.char_length(text), F.lit(1)))

    n = F.greatest(F.char_length(text), F.lit(1))
    shares = F.array(
        _kept(text, r"\p{Lu}") / n,
        _kept(text, r"\p{N}") / n,
        _kept(text, "#*$%&<>@_=~^") / n,
        _kept(text, "!") / n,
        _kept(text, "|") / n,
        _kept(text, ".?") / n,
        _kept(text, ",;:") / n,
        _kept(text, "\\n") / n,
    )
    return F.concat(let(words_of(text), of_words), let(F.split(text, "\n"), of_lines), shares).cast("array<double>")


@dataclass(frozen=True)
class Ranker:
    """score = sigmoid(weights . (features - centre) / scale + shift)."""

    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    shift: float

    def score(self, text: Column) -> Column:
        """Score from 0 to 1 of a text; a null text counts as empty."""
        if not self.weights:
            return F.lit(1 / (1 + np.exp(-self.shift))).cast("double")
        slopes = [w / s for w, s in zip(self.weights, self.scale, strict=True)]
        start = self.shift - sum(a * c for a, c in zip(slopes, self.centre, strict=True))
        terms = F.zip_with(features(F.coalesce(text, F.lit(""))), F.array(*map(F.lit, slopes)), lambda x, a: x * a)
        total = F.aggregate(terms, F.lit(float(start)), lambda sum_, term: sum_ + term)
        return let(total, lambda x: 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0)))))


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS) -> Ranker:
    """Weights from preference pairs of good over bad rows; without both kinds, every score is a half."""
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(better) or not len(worse):
        return Ranker((), (), (), 0.0)
    rng = np.random.default_rng(SEED)
    n = int(min(pairs, 50 * len(x)))
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = (x - centre) / scale
    difference = z[rng.choice(better, n)] - z[rng.choice(worse, n)]
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):  # Newton's method on the logistic loss
        p = 1 / (1 + np.exp(-np.clip(difference @ w, -30, 30)))
        gradient = difference.T @ (p - 1) / n + RIDGE * w
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / n + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    # The cut is a quantile of the scores: the one that leaves as large a share below it as the labels call bad,
    # halfway to the next score, so that the cut is no row's own score.
    ordered = np.sort(raw)
    at = len(worse)
    cut = (ordered[at - 1] + ordered[min(at, len(ordered) - 1)]) / 2
    return Ranker(tuple(w.tolist()), tuple(centre.tolist()), tuple(scale.tolist()), float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut))


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Ranker:
    """A ranker from docs (doc_id, text) and labels (doc_id, quality 0 or 1).

    Rows with a null doc_id, text or quality are not learnt from; of several labels of a doc_id the lowest
    counts, and of several texts that with the least features. The sample is at most limit doc_ids, those of
    least hash, so reruns agree.
    """
    wanted = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    # At most limit rows of two numbers, so the broadcast has a bound; and as many rows of features reach the driver.
    rows = (
        docs.select("doc_id", "text")
        .where("text is not null")
        .join(F.broadcast(wanted), "doc_id")
        .groupBy("doc_id")
        .agg(F.min(features(F.col("text"))).alias("x"), F.min("quality").alias("quality"))
        .orderBy("doc_id")
        .toPandas()
    )
    if not len(rows):
        return Ranker((), (), (), 0.0)
    return fit_pairs(np.stack(rows["x"].to_numpy()), rows["quality"].to_numpy() == 1)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this doc_id are never learnt from; true for a null one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def judge(docs: DataFrame, ranker: Ranker, text: str = "text") -> DataFrame:
    """docs with score and predicted (1 or 0), which replace columns of these names. Every row is judged by its own text; a null text counts as empty."""
    scored = docs.withColumn("score", ranker.score(text_of(text)))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def learn(docs: DataFrame, labels: DataFrame) -> Ranker:
    """A ranker from the labels that are not held out."""
    return fit(docs, labels.where(~held_out(F.col("doc_id"))))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learnt from the labels that are not held out."""
    judged = judge(docs.select("doc_id", "text"), learn(docs, labels))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The documents that the ranker predicts good, with their own columns. Null texts count as empty; repeated rows are each kept or not."""
    return docs.where(ranker.score(text_of()) >= THRESHOLD)
