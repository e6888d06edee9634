"""Mixing sources to target weights by Pareto order sampling.

A source's target of words, divided by its words, is the expected number of copies of its documents. The
whole copies are certain. The fraction left is an inclusion probability: documents are ranked by random odds
divided by inclusion odds, and the first ones are taken until the words of the remaining target are reached.

The rank order is never formed in one place: ranks fall into RANK_BUCKETS buckets, the words of each bucket
are summed, and only the one bucket of a source in which the target is reached is put in order. What
comes out is one cut point a source, and a document's copies follow from it and the document alone. So a source
with a third of all rows costs no more than others. Sources are numbered and their targets found by sums, so
there may be any number of them; texts are moved only where there are more than BROADCAST_SOURCES, and then
those of sources with few documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.llm.common import durable, join_counted, text_of, word_count

#: Relative weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: Most copies of a document.
MOST_COPIES = 3
SEED = 7
RANK_BUCKETS = 4096
#: Sources whose cut points may be broadcast.
BROADCAST_SOURCES = 20_000


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number between 0 and 1 that is the same for a doc_id in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_key(source: Column) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def numbered(sources: DataFrame) -> DataFrame:
    """sources with place: 0, 1, 2 ... in the order of source, null last. Each part of the order is numbered by itself."""
    parts = durable(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before, first = 0, []
    for row in parts.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        first.append((row["part"], before))
        before += row["count"]
    first = F.broadcast(parts.sparkSession.createDataFrame(first, "part int, first long"))
    within = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.join(first, "part").withColumn("place", F.col("first") + within - 1).drop("part", "first")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sources (source, source_size) with target: the share of all words by weight, most times its size at most.

    The excess over a limit is shared again by weight until no target is above: each round is a sum over all sources,
    and raises the words for a unit of weight.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    limits = durable(numbered(sources).withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most))))
    level, at_limit = 0.0, -1
    while True:
        full = F.col("limit") < F.col("weight") * F.lit(level)
        total = limits.agg(
            F.sum("source_size").alias("words"), F.sum(F.when(full, F.col("limit")).otherwise(0.0)).alias("given"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"), F.count(F.when(full, 1)).alias("n"),
        ).first()
        if total["n"] == at_limit or not total["weight"]:
            break
        level, at_limit = (total["words"] - total["given"]) / total["weight"], total["n"]
    return limits.select("source", "source_size", F.when(F.col("weight") * F.lit(level) <= F.col("limit"), F.lit(level) * F.col("weight")).otherwise(F.col("limit")).alias("target"))


def _slim(docs: DataFrame, weight: Column | None) -> DataFrame:
    weight = F.lit(1.0) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    return docs.select("doc_id", "source", word_count(text_of()).alias("size"), draw(F.col("doc_id")).alias("u"), weight.alias("weight"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with source) joined to plan, a row for each source with its number n of documents."""
    rows = rows.withColumn("key", source_key(F.col("source")))
    if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan.drop("n")), "key")
    return join_counted(rows, plan, "key", plan.agg(F.sum("n")).first()[0])


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with its source's columns of plan, certain copies, chance of one more, and rank: odds of the draw by inclusion odds, then doc_id and size."""
    expected = F.least(F.lit(float(MOST_COPIES)), F.col("rate") * F.col("weight"))
    joined = _with_plan(rows, plan).withColumn("certain", F.floor(expected)).withColumn("chance", expected - F.floor(expected))
    odds = F.col("u") / (1 - F.col("u")) / F.when(F.col("chance") > 0, F.col("chance") / (1 - F.col("chance")))
    rank = F.struct(F.coalesce(odds, F.lit(float("inf"))).alias("odds"), F.col("doc_id").alias("id"), F.col("size").alias("words"))
    return joined.withColumn("rank", rank)


def rates(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """plan (key, source_size, target, n) with rate: the expected copies of a document of weight 1.

    Expected copies are rate * weight, MOST_COPIES at most; what a limit leaves over goes to the source's other documents, as
    long as there are any. Each round is a sum over all documents, and raises rates.
    """
    at_limit, plan = -1, plan.withColumn("rate", F.lit(0.0))
    while True:
        full = F.col("rate") * F.col("weight") > MOST_COPIES
        sums = durable(_with_plan(slim, plan.select("key", "rate", "n")).groupBy("key").agg(
            F.sum(F.when(full, F.col("size")).otherwise(0)).alias("given"), F.sum(F.when(full, 0.0).otherwise(F.col("size") * F.col("weight"))).alias("free"), F.count(F.when(full, 1)).alias("full")
        ))
        reached = sums.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
        if reached == at_limit:
            return plan
        at_limit = reached
        rate = F.when(F.col("free") > 0, (F.col("target") - F.col("given") * F.lit(float(MOST_COPIES))) / F.when(F.col("free") > 0, F.col("free"))).otherwise(F.col("rate"))
        plan = durable(plan.join(sums, "key").withColumn("rate", rate).drop("given", "free", "full"))


def allocate(slim: DataFrame, weighted: bool = False) -> DataFrame:
    """A row for each source: key, source_size, target, rate (expected copies of a document of weight 1), cut (the last rank that
    is taken; null: none) and n, its documents.

    slim: doc_id, source, size (words), u and weight of every document, best already durable.
    """
    sizes = durable(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    key = source_key(F.col("source")).alias("key")
    plan = targets(sizes.drop("n")).select(key, "source_size", "target").join(sizes.select(key, "n"), "key")
    plan = durable(plan.withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))))
    if weighted:
        plan = rates(slim, plan.drop("rate"))
    ranked = durable(_ranked(slim, plan))
    certain = ranked.groupBy("key", "target").agg((F.col("target") - F.sum(F.col("certain") * F.col("size"))).alias("left")).drop("target")
    # A document that can't be taken once more takes no words of those left.
    ranked = ranked.withColumn("size", F.when(F.col("chance") > 0, F.col("size")).otherwise(0))
    odds = F.col("rank.odds")
    bucket = F.when(odds == float("inf"), RANK_BUCKETS).otherwise(F.floor(odds / (1 + F.when(odds < float("inf"), odds)) * RANK_BUCKETS))
    ranked = ranked.withColumn("bucket", bucket.cast("int")).select("key", "size", "rank", "bucket")
    words = ranked.groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.max("rank").alias("last")).join(certain, "key")
    running = W.partitionBy("key").orderBy("bucket")
    words = durable(words.withColumn("through", F.sum("words").over(running)).withColumn("before", F.col("through") - F.col("words")))
    whole = words.where("through <= left").groupBy("key").agg(F.max("last").alias("whole"))
    reached = words.where("before < left and through > left").select("key", "bucket", "before", "left")
    # Documents of equal rank are peers of a range frame, and are taken together.
    edge = ranked.join(reached, ["key", "bucket"]).withColumn("through", F.col("before") + F.sum("size").over(W.partitionBy("key").orderBy("rank")))
    steps = edge.groupBy("key", "left", "before", "through").agg(F.max("rank").alias("last"))
    steps = steps.withColumn("before", F.coalesce(F.lag("through").over(W.partitionBy("key").orderBy("through")), F.col("before")))
    nearest = (F.col("through") <= F.col("left")) | ((F.col("before") < F.col("left")) & (F.col("through") - F.col("left") < F.col("left") - F.col("before")))
    part = steps.where(nearest).groupBy("key").agg(F.max("last").alias("part"))
    cuts = plan.join(whole, "key", "left").join(part, "key", "left")
    return durable(cuts.select("key", "source_size", "target", "rate", F.coalesce("part", "whole").alias("cut"), "n"))


def _copies(ranked: DataFrame) -> Column:
    more = (F.col("chance") > 0) & F.coalesce(F.col("rank") <= F.col("cut"), F.lit(False))
    return F.col("certain").cast("int") + more.cast("int")


def report(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken (words of the document that the mix takes) of every row.

    weight: of a document within its source, which its expected copies are in proportion to; null and below 0 count as 0. By
    default all are alike. Null texts have no words. A null source is a source, the last in order. Rows of equal doc_id, size
    and weight get the same rank and are taken alike; a null doc_id draws like any other. An empty table gives no rows. Unless
    weights leave too few documents, the words taken of a source differ from its target by at most half of the row, or rows of
    equal rank, at the cut.
    """
    slim = durable(_slim(docs, weight))
    ranked = _ranked(slim, allocate(slim, weight is not None))
    return ranked.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(ranked)).cast("long").alias("taken"))


def mix(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """The documents of the mix (as of report); a document with several copies comes as often. Documents without words are left out.

    The columns of docs are kept, whatever their names.
    """
    cuts = allocate(durable(_slim(docs, weight)), weight is not None)
    given = F.lit(1.0) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    size, u = word_count(text_of()), draw(F.col("doc_id"))
    ranked = _ranked(docs.select(F.struct("*").alias("doc"), "doc_id", "source", size.alias("size"), u.alias("u"), given.alias("weight")), cuts)
    copies = F.when(F.col("size") > 0, _copies(ranked)).otherwise(0)
    taken = ranked.select("doc", copies.alias("copies")).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


ORACLE = f"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * {MOST_COPIES} AS cap,
        ([{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight
    FROM d GROUP BY source
), l AS (
    SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM s
), t AS (
    SELECT source, source_size, CASE WHEN level * weight <= cap
        THEN weight * (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1) ELSE cap END AS target
    FROM l
), e AS (
    SELECT d.*, source_size, target, floor(target / source_size) AS certain,
        target / source_size - floor(target / source_size) AS chance, target - floor(target / source_size) * source_size AS words_left
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (
    SELECT *, sum(size) OVER w AS through, sum(size) OVER w - sum(size) OVER (PARTITION BY source, odds, doc_id, size) AS before
    FROM (SELECT *, u / (1 - u) / (chance / (1 - chance)) AS odds FROM e)
    WINDOW w AS (PARTITION BY source ORDER BY odds, doc_id, size)
)
SELECT doc_id, size, source_size, target, (size * CASE WHEN size = 0 THEN 0 ELSE certain + CASE WHEN chance > 0 AND (through <= words_left
    OR (before < words_left AND through - words_left < words_left - before)) THEN 1 ELSE 0 END END)::BIGINT AS taken
FROM r
"""
