"""The URL models in one process, to hold the operator's figures against."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import durable
from barline.llm.url_filter import _BASE, ORDER, SMOOTHING, _codes, _grams, count_grams, threshold_of


@dataclass(frozen=True)
class Markov:
    """Counts of n-grams by order, sorted by n-gram."""

    grams: tuple[np.ndarray, ...]
    counts: tuple[np.ndarray, ...]

    def log_likelihood(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each character, given those before it."""
        p = np.full(len(at), 1 / _BASE)
        for order in range(ORDER + 1):
            grams, counts = self.grams[order], self.counts[order]
            if not len(grams):
                continue
            contexts, first = np.unique(grams // _BASE, return_index=True)
            totals = np.add.reduceat(counts, first)
            wanted = _grams(codes, at, order)
            seen = _look_up(grams, counts, wanted)
            total = _look_up(contexts, totals, wanted // _BASE)
            p = (seen + SMOOTHING * p) / (total + SMOOTHING)
        return np.log(p)


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0).astype(np.float64)


@dataclass(frozen=True)
class Filter:
    accepted: Markov
    rejected: Markov
    threshold: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood difference by character, less the threshold; an empty text has the bare 0 - threshold."""
        codes, at = _codes(texts)
        owner = np.repeat(np.arange(len(texts)), [len(t.lower().encode("utf-8")) for t in texts])
        difference = self.accepted.log_likelihood(codes, at) - self.rejected.log_likelihood(codes, at)
        total = np.bincount(owner, difference, minlength=len(texts))
        length = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        return total / length - self.threshold


def fit(texts: DataFrame) -> Filter:
    """A filter in memory from texts (verdict allow or block, text), for small tables.

    Without rows of both verdicts the figures are 0 and everything is allowed.
    """
    texts = durable(texts.groupBy("verdict", "text").agg(F.count("*").alias("times")))
    kept = count_grams(texts).toPandas()
    models = {}
    for verdict in ("allow", "block"):
        parts = [kept[(kept["verdict"] == verdict) & (kept["n"] == order)].sort_values("gram") for order in range(ORDER + 1)]
        models[verdict] = Markov(tuple(p["gram"].to_numpy(np.int64) for p in parts), tuple(p["count"].to_numpy(np.int64) for p in parts))
    empty = Markov((np.zeros(0, np.int64),) * (ORDER + 1), (np.zeros(0, np.int64),) * (ORDER + 1))
    if not all(len(m.grams[0]) for m in models.values()):
        return Filter(empty, empty, 0.0)
    return Filter(models["allow"], models["block"], threshold_of(texts))
