"""Exact top-k search by inner product, with a three-phase uniform threshold.

Candidates are dealt to groups of bounded size, by turns; every query goes to each group of its length, and streams past the
group's candidates. The dimensions are cut into SEGMENTS, those in which a group's candidates vary most coming first.

1. Each group lists, for each query, the candidates of the highest partial scores in the first segment, and sends the best of
   their whole scores. The k-th highest of what is gathered is a safe cutoff: k candidates reach it.
2. The cutoffs travel with the queries. Segment by segment, a candidate goes on only while its partial score and the bound of
   what is left (the product of the lengths of the rest of both vectors) can reach the cutoff. A pair that can't is not
   multiplied further.
3. What is left is scored exactly, cut to the group's best k, and the best k of all groups remain.

So candidates are read twice however many queries there are, and no step runs on the driver. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.llm.common import durable

K, SEGMENTS, SCALE = 10, 4, 1024
#: Components of a group's candidates, about, and rows that are worth a group of their own.
GROUP_VALUES, GROUP_ROWS = 1 << 22, 2048
#: Queries and candidates of a tile.
TILE_QUERIES, TILE_CANDIDATES = 128, 4096
#: A tile of which a larger share of pairs is still in reach is multiplied as a matrix, else pair by pair.
DENSE = 1 / 16
#: Relative error allowed for in bounds: far above what sums of a million floats can lose.
SLACK = 1e-9


def _whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as floats, which hold it exactly (but for an overflow to infinity)."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * values)


def _as_ints(values: np.ndarray) -> list[int]:
    """floor(SCALE * x) as Python's integers."""
    return [int(x) * SCALE if abs(x) >= 1 << 53 else int(np.floor(SCALE * x)) for x in values.tolist()]


class Block:
    """Vectors of one length, cut into segments: whole components, and lengths of what follows each segment."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.values, whole = ids, values, _whole(values)
        with np.errstate(over="ignore", invalid="ignore"):
            self.order = np.argsort(-np.nan_to_num(whole.var(axis=0), nan=np.inf), kind="stable") if order is None else order
            self.whole = whole[:, self.order]
            self.cuts = np.linspace(0, whole.shape[1], min(SEGMENTS, whole.shape[1]) + 1).astype(int)
            squares = np.cumsum(np.square(self.whole[:, ::-1]), axis=1)[:, ::-1]
            self.rest = np.sqrt(np.stack([squares[:, cut] if cut < whole.shape[1] else np.zeros(len(whole)) for cut in self.cuts]))
        self.largest = np.abs(whole).max(initial=0.0)

    def part(self, start: int, stop: int) -> Block:
        return Block(self.ids[start:stop], self.values[start:stop], self.order)


def exact(queries: Block, rows: Block, at: np.ndarray, to: np.ndarray) -> list[int] | np.ndarray:
    """Scores of the pairs (at[i], to[i]), whatever the size of the components: in floats or longs where these hold every sum."""
    most = queries.largest * rows.largest * queries.whole.shape[1]
    if most < 1 << 62:
        kind = np.float64 if most < 1 << 53 else np.int64
        step, out = max(1, (1 << 22) // queries.whole.shape[1]), [np.zeros(0, np.int64)]
        for start in range(0, len(at), step):
            a, b = queries.whole[at[start : start + step]].astype(kind), rows.whole[to[start : start + step]].astype(kind)
            out.append(np.einsum("ij,ij->i", a, b).astype(np.int64))
        return np.concatenate(out)
    known = {i: _as_ints(rows.values[i]) for i in set(to.tolist())}
    asked = {i: _as_ints(queries.values[i]) for i in set(at.tolist())}
    return [sum(x * y for x, y in zip(asked[a], known[b], strict=True)) for a, b in zip(at.tolist(), to.tolist(), strict=True)]


def in_reach(queries: Block, rows: Block, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (positions) that can reach the queries' cutoffs, none with the query's own id; and how many products it took."""
    alive = queries.ids[:, None] != rows.ids[None, :]
    total, products = np.zeros(alive.shape), 0
    with np.errstate(over="ignore", invalid="ignore"):
        # Sums in floats may be off by a share of the vectors' lengths.
        slack = SLACK * (queries.rest[0][:, None] * rows.rest[0][None, :] + np.abs(np.nan_to_num(low, neginf=0.0))[:, None]) + 1e-6
        for s, (start, stop) in enumerate(zip(queries.cuts, queries.cuts[1:], strict=False)):
            n = np.count_nonzero(alive)
            if n > DENSE * alive.size:
                some, others = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
                total[np.ix_(some, others)] += queries.whole[some, start:stop] @ rows.whole[others, start:stop].T
                products += len(some) * len(others) * (stop - start)
            else:
                at, to = np.nonzero(alive)
                total[at, to] += np.einsum("ij,ij->i", queries.whole[at, start:stop], rows.whole[to, start:stop])
                products += n * (stop - start)
            bound = total + queries.rest[s + 1][:, None] * rows.rest[s + 1][None, :] + slack
            alive &= ~(bound < low[:, None])  # what overflows is no number, and stays
            if not alive.any():
                break
    at, to = np.nonzero(alive)
    return at, to, products


def best_of(at: np.ndarray, ids: np.ndarray, scores: list[int] | np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k highest scores, ties to smaller ids."""
    if isinstance(scores, list):
        order = np.array(sorted(range(len(at)), key=lambda i: (at[i], -scores[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -scores, at))
    first = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


def heads(queries: Block, rows: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each query and its k candidates of the highest partial scores in the first segment."""
    with np.errstate(over="ignore", invalid="ignore"):
        partial = np.nan_to_num(queries.whole[:, : queries.cuts[1]] @ rows.whole[:, : rows.cuts[1]].T)
    partial[queries.ids[:, None] == rows.ids[None, :]] = -np.inf
    n = min(k, len(rows.ids))
    to = np.argpartition(partial, -n, axis=1)[:, -n:].ravel()
    at = np.repeat(np.arange(len(queries.ids)), n)
    own = queries.ids[at] == rows.ids[to]
    return at[~own], to[~own]


def _streams(batches: Iterator[pa.RecordBatch], answer: Callable[[Block, Block, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dims, group, asks, id, vector, low) come sorted by the first three: the candidates of a group, which are kept, then
    queries, which stream past them in tiles."""
    key, ids, values, tiles = None, [], [], None
    for batch in batches:
        dims, group, asks, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        low = batch.column(5).to_numpy(zero_copy_only=False).astype(np.float64)  # null: not a number
        starts = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (group[1:] != group[:-1]) | (asks[1:] != asks[:-1])]) if len(dims) else []
        for start, stop in zip(starts, [*starts[1:], len(dims)], strict=True):
            if (dims[start], group[start]) != key:
                key, ids, values, tiles = (dims[start], group[start]), [], [], None
            vectors = batch.column(4).slice(start, stop - start).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims[start]).astype(np.float64)
            if not asks[start]:
                ids.append(own[start:stop])
                values.append(vectors)
                continue
            if tiles is None and ids:
                whole = Block(np.concatenate(ids), np.concatenate(values))
                tiles, ids, values = [whole.part(i, i + TILE_CANDIDATES) for i in range(0, len(whole.ids), TILE_CANDIDATES)], [], []
            for at in range(start, stop, TILE_QUERIES):
                upto = min(at + TILE_QUERIES, stop)
                for rows in tiles or []:
                    asked = Block(own[at:upto], vectors[at - start : upto - start], rows.order)
                    yield answer(asked, rows, np.nan_to_num(low[at:upto], nan=-np.inf))


def _scores(queries: Block, rows: Block, at: np.ndarray, to: np.ndarray, k: int, cutoffs: bool = False) -> pa.RecordBatch:
    """query_id, vec_id and score of each query's best k of the pairs. A score that doesn't fit a long is an error, unless it is only for a cutoff."""
    scores = exact(queries, rows, at, to)
    if isinstance(scores, list) and cutoffs:  # a lower cutoff is safe; one below all longs says nothing
        there = [i for i, score in enumerate(scores) if score >= -(1 << 63)]
        at, to, scores = at[there], to[there], [min(scores[i], (1 << 63) - 1) for i in there]
    best = best_of(at, rows.ids[to], scores, k)
    wanted = pa.array([scores[i] for i in best.tolist()] if isinstance(scores, list) else scores[best], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(queries.ids[at[best]]), pa.array(rows.ids[to[best]]), wanted], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = K, embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every query its k highest inner products (all, if fewer) among all other rows.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null vec_id; all others
    do, whatever their size: an error is raised only where a score among the best of a group doesn't fit a long. Vectors of another length than
    the query's are no candidates for it. A row with the query's vec_id counts as the query's own; of several query rows with one
    vec_id, the one with the least vector is asked. Ties go to the smaller vec_id; rows that share a vec_id are candidates each.
    Other columns play no part. An empty table, or one without queries, gives no rows.
    """
    value = F.col(embedding)
    finite = F.forall(value, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    usable = vectors.select(F.col("vec_id").cast("long").alias("id"), value.alias("vector"), is_query.alias("asks"), finite.alias("finite"))
    usable = usable.where("id is not null and finite and size(vector) > 0").drop("finite").withColumn("dims", F.size("vector"))
    usable = durable(usable.withColumn("turn", F.monotonically_increasing_id()))
    size = usable.agg(F.count("*").alias("rows"), F.coalesce(F.sum("dims"), F.lit(0)).alias("values")).first()
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-size["values"] // GROUP_VALUES), min(-(-size["rows"] // GROUP_ROWS), 2 * parallel))
    candidates = usable.select("dims", F.pmod("turn", F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("asks"), "id", "vector", F.lit(None).cast("long").alias("low"))
    asked = durable(usable.where("asks").groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dims", F.size("vector")))

    def met(queries: DataFrame) -> DataFrame:
        group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
        rows = candidates.unionByName(queries.select("dims", group, F.lit(1).alias("asks"), "id", "vector", "low"))
        return rows.repartition("dims", "group").sortWithinPartitions("dims", "group", "asks")

    # With many groups few of each are needed: the k-th highest of one from each is reached by k candidates.
    each = min(k, -(-2 * k // groups) + 1)

    def phase_1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _streams(batches, lambda queries, rows, low: _scores(queries, rows, *heads(queries, rows, k), each, cutoffs=True))

    def phase_2_and_3(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _streams(batches, lambda queries, rows, low: _scores(queries, rows, *in_reach(queries, rows, low)[:2], k))

    kind = "query_id long, vec_id long, score long"
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    gathered = met(asked.withColumn("low", F.lit(None).cast("long"))).mapInArrow(phase_1, kind)
    cutoffs = gathered.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("low"))
    found = met(asked.join(durable(cutoffs), "id", "left")).mapInArrow(phase_2_and_3, kind)
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    """The search for every vector whose id is divisible by 100."""
    return search(vectors, F.col("vec_id") % 100 == 0)


ORACLE = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""
