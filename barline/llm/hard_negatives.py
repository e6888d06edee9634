"""Hard negatives: rows of another label whose score lies in a window below a positive's, through vantage-point trees.

Vectors of one group (of bounded size) get one component more, so that all are equally long: sqrt(M^2 - |x|^2), with M the length of
the longest. An anchor gets a zero. The squared distance between them is then |q|^2 + M^2 - 2 q x, so the nearest row is the one of the
highest score, and a window of scores is an annulus around the anchor.

Each group has a tree: a vantage point, and the rows nearer and farther than the median, with the least and greatest distance on either
side. By the triangle inequality these bound the distances between an anchor and all rows of a branch, so a branch outside the annulus
is never entered. A traversal goes nearest first: leaves come by the highest score they can hold, one, then two, then four at a time,
and it stops once it has k rows of a label that fits, all above what any leaf that is left can hold.

Two traversals: the best k rows of the anchor's label, from all groups, are its positives; they make the windows of the second, in which
the best k rows of other labels are wanted. Anchors go to each group, and stream past its tree.

Bounds are floating-point and have some slack; scores are exact integers, and these decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.llm.common import durable

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: The window of a negative's score, in hundredths of the positive's.
LEAST, MOST = 30, 90
#: Components of a group's rows, about, and rows that are worth a group of their own; rows of a leaf.
GROUP_VALUES, GROUP_ROWS, LEAF = 1 << 22, 2048, 128
#: Relative error allowed for in bounds: far above what sums of a million floats can lose.
SLACK = 1e-9


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), which floats hold exactly; Python's integers where products of such numbers could overflow."""
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * values)
    if np.isfinite(scaled).all() and (np.abs(scaled).max(initial=0.0) ** 2) * values.shape[1] < 1 << 53:
        return scaled
    exact = [[int(x) * SCALE if abs(x) >= 1 << 53 else int(np.floor(SCALE * x)) for x in row] for row in values.tolist()]
    return np.array(exact, object).reshape(values.shape)


class Tree:
    """A vantage-point tree over some rows (ids, label numbers, whole components). The rows of a leaf lie side by side."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        with np.errstate(over="ignore", invalid="ignore"):
            points = values.astype(np.float64)
            squares = np.einsum("ij,ij->i", points, points)
            self.longest = squares.max(initial=0.0)
            points = np.column_stack([points, np.sqrt(np.maximum(self.longest - squares, 0.0))])
            #: Of each branch below the root: the branch above it, that one's vantage point, and the least and greatest distance of its rows from that.
            self.branches: list[tuple[int, np.ndarray, float, float]] = []
            self.leaves: list[tuple[int, np.ndarray]] = []
            self._grow(points, np.arange(len(ids)), -1)
        order = np.concatenate([rows for _, rows in self.leaves])
        self.ids, self.labels, self.values = ids[order], labels[order], values[order]
        self.starts = np.cumsum([0, *(len(rows) for _, rows in self.leaves)])
        self.largest = float(np.abs(self.values).max(initial=0.0)) if values.dtype != object else np.inf

    def _grow(self, points: np.ndarray, rows: np.ndarray, branch: int) -> None:
        cut = None
        if len(rows) > LEAF:
            # The row farthest from the first one: a corner, whose spheres cut more evenly than those of a row in the middle.
            vantage = points[rows[int(np.argmax(np.linalg.norm(points[rows] - points[rows[0]], axis=1)))]]
            distance = np.linalg.norm(points[rows] - vantage, axis=1)
            # Equal rows, or such as floats can't tell apart, are one leaf.
            cut = np.argsort(distance, kind="stable") if np.isfinite(distance).all() and distance.min() < distance.max() else None
        if cut is None:
            self.leaves.append((branch, rows))
            return
        for side in (cut[: len(rows) // 2], cut[len(rows) // 2 :]):
            self.branches.append((branch, vantage, float(distance[side[0]]), float(distance[side[-1]])))
            self._grow(points, rows[side], len(self.branches) - 1)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest and lowest score that each leaf can hold for each query; no number where floats can't tell."""
        with np.errstate(over="ignore", invalid="ignore"):
            points = np.column_stack([queries.astype(np.float64), np.zeros(len(queries))])
            reach = np.einsum("ij,ij->i", points, points) + self.longest
            slack = SLACK * reach + 1e-6
            most, fewest = [], []
            for above, vantage, least, greatest in self.branches:
                away = np.linalg.norm(points - vantage, axis=1)
                nearest = np.maximum(np.maximum(away - greatest, least - away), 0.0)
                high, low = (reach - nearest * nearest) / 2 + slack, (reach - np.square(away + greatest)) / 2 - slack
                most.append(high if above < 0 else np.minimum(most[above], high))
                fewest.append(low if above < 0 else np.maximum(fewest[above], low))
            none = np.full(len(queries), np.nan)
            return tuple(np.array([x[branch] if branch >= 0 else none for branch, _ in self.leaves]) for x in (most, fewest))

    def _rows(self, leaves: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.starts[leaf], self.starts[leaf + 1]) for leaf in leaves])

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact scores of some rows: longs, or Python's integers where longs can't hold them."""
        if query.dtype != object and self.values.dtype != object and np.abs(query).max(initial=0.0) * self.largest * len(query) < 1 << 53:
            return (self.values[rows] @ query).astype(np.int64)
        a = [int(x) for x in query]
        return np.array([sum(x * int(y) for x, y in zip(a, row, strict=True)) for row in self.values[rows]], object)


class Asked:
    """An anchor at a tree: bounds of the leaves, which rows fit, and the scores that have been worked out."""

    def __init__(self, tree: Tree, query: np.ndarray, most: np.ndarray, fewest: np.ndarray, fits: np.ndarray):
        self.tree, self.query, self.most, self.fewest, self.fits = tree, query, most, fewest, fits
        self.leaves: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _leaf(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the rows of a leaf that fit."""
        if leaf not in self.leaves:
            rows = np.flatnonzero(self.fits[self.tree.starts[leaf] : self.tree.starts[leaf + 1]]) + self.tree.starts[leaf]
            self.leaves[leaf] = self.tree.scores(self.query, rows), self.tree.ids[rows]
        return self.leaves[leaf]

    def nearest(self, low: int | None, high: int | None, k: int) -> list[tuple[int, int]]:
        """(score, id) of the first k rows that fit, with low <= score <= high: by score descending, then id ascending."""
        # Written so that what is no number prunes nothing.
        entered = np.ones(len(self.most), bool)
        if low is not None:
            entered &= ~(self.most < low)
        if high is not None:
            entered &= ~(self.fewest > high)
        can = np.nan_to_num(self.most, nan=np.inf) if high is None else np.fmin(self.most, float(high) + 1.0)
        leaves = np.flatnonzero(entered)
        leaves = leaves[np.argsort(-can[leaves], kind="stable")]
        scores, ids, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 1
        while at < len(leaves):
            if len(scores) >= k and scores[k - 1] > can[leaves[at]]:
                break
            found = [self._leaf(leaf) for leaf in leaves[at : at + step].tolist()]
            more = np.concatenate([x for x, _ in found])
            inside = np.ones(len(more), bool)
            if low is not None:
                inside &= (more >= low).astype(bool)
            if high is not None:
                inside &= (more <= high).astype(bool)
            scores, ids = np.concatenate([scores, more[inside]]), np.concatenate([ids, np.concatenate([x for _, x in found])[inside]])
            order = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), np.int64)
            scores, ids = scores[order[:k]], ids[order[:k]]
            at, step = at + step, 2 * step
        return list(zip(scores.tolist(), ids.tolist(), strict=True))


def _streams(batches: Iterator[pa.RecordBatch], answer: Callable) -> Iterator[pa.RecordBatch]:
    """Rows (dims, group, asks, id, label, vector, positives) come sorted by the first three: a group's rows, which make its tree, then anchors."""
    key, parts, tree, numbers = None, [], None, {}

    def number(labels: list, grow: bool) -> np.ndarray:
        return np.array([numbers.setdefault(x, len(numbers)) if grow else numbers.get(x, -1) for x in labels], np.int64)

    for batch in batches:
        dims, group, asks, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        labels, wanted = batch.column(4).to_pylist(), batch.column(6)
        starts = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (group[1:] != group[:-1]) | (asks[1:] != asks[:-1])]) if len(dims) else []
        for start, stop in zip(starts, [*starts[1:], len(dims)], strict=True):
            if (dims[start], group[start]) != key:
                key, parts, tree, numbers = (dims[start], group[start]), [], None, {}
            vectors = batch.column(5).slice(start, stop - start).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims[start]).astype(np.float64)
            if not asks[start]:
                parts.append((own[start:stop], number(labels[start:stop], True), vectors))
                continue
            if parts:
                ids, kinds, values = (np.concatenate(x) for x in zip(*parts, strict=True))
                tree, parts = Tree(ids, kinds, whole(values)), []
            if tree is not None:
                asked, kinds = whole(vectors), number(labels[start:stop], False)
                most, fewest = tree.bounds(asked)
                rows = [row for i in range(stop - start) for row in answer(tree, int(own[start + i]), kinds[i], (asked[i], most[:, i], fewest[:, i]), wanted[start + i].as_py())]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["anchor_id", "positive_id", "positive_score", "found_id", "score"])


def _positives(tree: Tree, own: int, label: int, asked: tuple[np.ndarray, ...], _: object) -> Iterator[tuple]:
    for score, found in Asked(tree, *asked, (tree.labels == label) & (tree.ids != own)).nearest(None, None, POSITIVES):
        yield own, None, None, found, score


def window(score: int) -> tuple[int, int]:
    """Least and greatest score with LEAST * score <= 100 * it <= MOST * score."""
    return -(-LEAST * score // 100), MOST * score // 100


def _negatives(tree: Tree, own: int, label: int, asked: tuple[np.ndarray, ...], positives: list[dict]) -> Iterator[tuple]:
    one = Asked(tree, *asked, (tree.labels != label) & (tree.ids != own))
    for positive in positives:
        low, high = window(positive["score"])
        if low <= high:
            for score, found in one.nearest(low, high, NEGATIVES):
                yield own, positive["found_id"], positive["score"], found, score


def mine(vectors: DataFrame, is_anchor: Column, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every anchor and each of its first POSITIVES rows of
    its label, the first NEGATIVES rows of other labels in the window (all, if fewer). Higher scores come first, then smaller vec_ids.

    Rows with a null vec_id, label or vector, an empty vector, or one with null or non-finite components take no part; rows of another
    length than the anchor's are neither positives nor negatives of it. A row with the anchor's vec_id counts as the anchor's own, and
    is neither. Of several anchors with one vec_id, the one with the least label and vector asks; other rows that share a vec_id
    count each. A positive with a score below zero has no window. A score that doesn't fit a long is an error. Other columns play no
    part. An empty table, or one without anchors, gives no rows.
    """
    value = F.col(embedding)
    finite = F.forall(value, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    usable = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col(label).alias("label"), value.alias("vector"), is_anchor.alias("asks"), finite.alias("finite"))
    usable = usable.where("id is not null and label is not null and finite and size(vector) > 0").drop("finite").withColumn("dims", F.size("vector"))
    usable = durable(usable.withColumn("turn", F.monotonically_increasing_id()))
    size = usable.agg(F.count("*").alias("rows"), F.coalesce(F.sum("dims"), F.lit(0)).alias("values")).first()
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-size["values"] // GROUP_VALUES), min(-(-size["rows"] // GROUP_ROWS), 2 * parallel))
    none = F.lit(None).cast("array<struct<found_id:long,score:long>>").alias("positives")
    rows = usable.select("dims", F.pmod("turn", F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("asks"), "id", "label", "vector", none)
    first = F.min(F.struct("label", "vector", "dims")).alias("first")
    anchors = durable(usable.where("asks").groupBy("id").agg(first).select("id", "first.*"))

    def met(asked: DataFrame, answer: Callable) -> DataFrame:
        group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
        both = rows.unionByName(asked.select("dims", group, F.lit(1).alias("asks"), "id", "label", "vector", "positives"))
        dealt = both.repartition("dims", "group").sortWithinPartitions("dims", "group", "asks")
        return dealt.mapInArrow(lambda batches: _streams(batches, answer), "anchor_id long, positive_id long, positive_score long, found_id long, score long")

    best = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "found_id"))
    positives = met(anchors.withColumn("positives", none), _positives).withColumn("rank", best).where(F.col("rank") <= POSITIVES)
    lists = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("found_id", "score")).alias("positives"))  # POSITIVES at most
    found = met(anchors.join(durable(lists), "id"), _negatives).distinct()
    by = W.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("score"), "found_id")
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= NEGATIVES)
    return found.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def report(vectors: DataFrame) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100, with the label of every seventh vector moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = f"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LEAST}::HUGEINT * positive_score <= 100 * score::HUGEINT AND 100 * score::HUGEINT <= {MOST}::HUGEINT * positive_score
QUALIFY rank <= {NEGATIVES}
"""
