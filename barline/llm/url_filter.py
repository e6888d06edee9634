"""URL filter: host and path rules, and a character language-model ratio where no rule fits.

Two variable-order Markov models, of accepted and of rejected URLs, are counted over every URL that a rule
decides. A context is used at the longest order at which it was seen; shorter orders smooth longer ones. A URL's
figure is the difference of its log-likelihoods under the two models divided by its length. The threshold is
calibrated on figures of URLs that were held out of models made for that; the models that judge count all.

Counts are made batch by batch in the tasks, then summed by n-gram, and stay distributed tables: all n-grams and
contexts count. The longest n-gram at a character fixes its estimate at every order, so each distinct one is
estimated once, by joins with the counts, and joined to the URLs that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import durable, join_counted

#: (verdict, host, start of the path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER = 4
#: Weight of the shorter order in a context's estimate, in observations.
SMOOTHING = 4.0
#: One URL in so many, by hash, is held out to calibrate the threshold.
HELD_OUT = 5
#: Parts that the URLs of one n-gram are dealt to; n-grams of every URL would else meet in one task.
SALTS = 16
#: Bins of the histogram that calibrates the threshold, from -SPAN to SPAN.
BINS, SPAN = 2000, 5.0
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789.-/_"
_BASE = len(CHARACTERS) + 2  # and any other byte, and the start
_CODES = np.full(256, len(CHARACTERS), np.int64)
_CODES[np.frombuffer(CHARACTERS.encode(), np.uint8)] = np.arange(len(CHARACTERS))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits a host or its parent domain and starts the path; null if none.

    Of rules of one length the first in alphabetical order wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of all texts, each after ORDER start codes; and the position of each text's character in them."""
    data = [text.lower().encode("utf-8") for text in texts]
    flat = _CODES[np.frombuffer(b"".join(data), np.uint8)]
    lengths = np.array([len(x) for x in data], np.int64)
    owner = np.repeat(np.arange(len(data)), lengths)
    codes = np.full(len(flat) + ORDER * len(data), _BASE - 1, np.int64)
    at = np.arange(len(flat)) + ORDER * (owner + 1)
    codes[at] = flat
    return codes, at


def _grams(codes: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The order characters before each position and the one at it, as one number."""
    gram = np.zeros(len(at), np.int64)
    for back in range(order, -1, -1):
        gram = gram * _BASE + codes[at - back]
    return gram


def count_grams(texts: DataFrame) -> DataFrame:
    """verdict, n (order), gram and count over all rows of texts (verdict, text, times: how often the row counts)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, texts_, times = (batch.column(i).to_pylist() for i in range(3))
            for verdict in ("allow", "block"):
                chosen = [i for i, v in enumerate(verdicts) if v == verdict]
                codes, at = _codes([texts_[i] for i in chosen])
                weights = np.repeat([times[i] for i in chosen], [len(texts_[i].lower().encode("utf-8")) for i in chosen])
                for order in range(ORDER + 1):
                    gram, place = np.unique(_grams(codes, at, order), return_inverse=True)
                    counts = np.bincount(place, weights, minlength=len(gram)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([verdict] * len(gram), pa.string()), pa.array(np.full(len(gram), order, np.int32)), pa.array(gram), pa.array(counts)],
                        names=["verdict", "n", "gram", "count"],
                    )

    counted = texts.select("verdict", "text", "times").mapInArrow(count, "verdict string, n int, gram long, count long")
    return counted.groupBy("verdict", "n", "gram").agg(F.sum("count").alias("count"))


def is_held_out(text: Column) -> Column:
    return F.pmod(F.xxhash64(text, F.lit("held out")), F.lit(HELD_OUT)) == 0


def held_out_scores(training: DataFrame) -> DataFrame:
    """verdict, score (without a threshold) and times of the held-out URLs, by models of the others. training: distinct URLs and their times."""
    held = durable(training.where(is_held_out(F.col("text"))))
    return held.join(raw_scores(held, training.where(~is_held_out(F.col("text")))), "text").select("verdict", "score", "times")


def threshold_of(training: DataFrame) -> float:
    """The threshold from held-out URLs; 0 if these or the others aren't of both verdicts."""
    scores = durable(held_out_scores(training))
    return calibrated(scores) if scores.select("verdict").distinct().count() == 2 else 0.0


def calibrated(scored: DataFrame) -> float:
    """The threshold with the fewest errors, as shares of each verdict, on scored rows (verdict, score, times)."""
    bins = scored.groupBy("verdict", F.floor((F.greatest(F.least("score", F.lit(SPAN)), F.lit(-SPAN)) + SPAN) / (2 * SPAN) * BINS).alias("bin")).agg(F.sum("times").alias("count"))
    shares = np.zeros((2, BINS + 1))
    for row in bins.collect():  # two rows a bin at most
        shares[int(row["verdict"] == "allow"), row["bin"]] = row["count"]
    shares /= shares.sum(axis=1, keepdims=True)
    # Allowed below a cut, and blocked from it on, are errors; the middle of the best cuts is taken.
    errors = np.r_[0, np.cumsum(shares[1])] + np.r_[0, np.cumsum(shares[0])][-1] - np.r_[0, np.cumsum(shares[0])]
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    cut = best[len(best) // 2]
    return float(cut / BINS * 2 * SPAN - SPAN)


def grams_of(texts: DataFrame) -> DataFrame:
    """key, gram and times of the distinct longest n-grams of each text (key, text); nothing for an empty one."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.slice(start, 1000)
                found = part.column(1).to_pylist()
                codes, at = _codes(found)
                owner = np.repeat(np.arange(len(found)), [len(t.lower().encode("utf-8")) for t in found])
                size = _BASE ** (ORDER + 1)
                pairs, times = np.unique(owner * size + _grams(codes, at, ORDER), return_counts=True)
                keys = part.column(0).to_numpy(zero_copy_only=False)[pairs // size]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(pairs % size), pa.array(times.astype(np.int64))], names=["key", "gram", "times"])

    return texts.select("key", "text").mapInArrow(grams, "key long, gram long, times long")


def estimates(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """gram and difference: its log-likelihood under the accepted model less that under the rejected one.

    grams: distinct longest n-grams; counts as of count_grams. Tables of few characters are bounded by the alphabet, and broadcast.
    """
    sides = {"a": "allow", "b": "block"}
    made = grams.select("gram", *[F.lit(1 / _BASE).alias(f"p_{x}") for x in sides])
    for order in range(ORDER + 1):
        of_order = counts.where(F.col("n") == order)
        of = [F.sum(F.when(F.col("verdict") == verdict, F.col("count")).otherwise(0)) for verdict in sides.values()]
        seen = of_order.groupBy(F.col("gram").alias("own")).agg(*[c.alias(f"seen_{x}") for x, c in zip(sides, of, strict=True)])
        total = of_order.groupBy(F.expr(f"gram div {_BASE}").alias("context")).agg(*[c.alias(f"total_{x}") for x, c in zip(sides, of, strict=True)])
        made = made.withColumn("own", F.col("gram") % _BASE ** (order + 1)).withColumn("context", F.expr(f"own div {_BASE}"))
        made = made.join(F.broadcast(seen) if order < 3 else seen, "own", "left").join(F.broadcast(total) if order < 4 else total, "context", "left")
        p = [((F.coalesce(f"seen_{x}", F.lit(0)) + SMOOTHING * F.col(f"p_{x}")) / (F.coalesce(f"total_{x}", F.lit(0)) + SMOOTHING)).alias(f"p_{x}") for x in sides]
        made = made.select("gram", *p)
    return made.select("gram", (F.log("p_a") - F.log("p_b")).alias("difference"))


def raw_scores(texts: DataFrame, training: DataFrame) -> DataFrame:
    """text and score, without a threshold, of the distinct texts (text), by models of training (verdict, text, times)."""
    keyed = durable(texts.select("text").distinct().withColumn("key", F.monotonically_increasing_id()))
    counts = durable(count_grams(training))
    if counts.select("verdict").distinct().count() < 2:
        return keyed.select("text", F.lit(0.0).alias("score"))
    held = grams_of(keyed)
    table = estimates(held.select("gram").distinct(), counts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = held.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(table, ["gram", "salt"])
    sums = met.groupBy("key").agg((F.sum(F.col("times") * F.col("difference")) / F.sum("times")).alias("score"))
    return keyed.join(sums, "key", "left").select("text", F.coalesce("score", F.lit(0.0)).alias("score"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict (allow or block) and score, the method's figure for every row.

    A rule's verdict stands; elsewhere a score of 0 or more allows. The models see the whole URL, a null one as empty;
    rules see host and path, which are empty without ://. Repeated rows count as often as they come. Columns of pages
    with these names are replaced, all others are kept. An empty table gives no rows.
    """
    made = ("host", "path", "rule", "verdict", "score")
    given = pages.select(F.struct(*[F.col(f"`{name}`") for name in pages.columns]).alias("page"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("text"))
    urls = durable(given.groupBy("text").agg(F.count("*").alias("n")).withColumn("host", host_of(F.col("text"))).withColumn("path", path_of(F.col("text"))))
    urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    training = durable(urls.where("rule is not null").select("rule.verdict", "text", F.col("n").alias("times")))
    scores = raw_scores(urls, training).withColumn("score", F.col("score") - F.lit(threshold_of(training)))
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("score") >= 0, "allow").otherwise("block"))
    judged = durable(urls.join(scores, "text").select("text", "n", "host", "path", F.col("rule.rule").alias("rule"), verdict.alias("verdict"), "score"))
    return join_counted(given, judged, "text", pages.count()).select(*[F.col("page")[name].alias(name) for name in pages.columns if name not in made], *made)


def report(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
