"""SimHash near-duplicates through vantage-point trees.

Fingerprints: one pass over the whole texts. Equal fingerprints collapse to one row first, so a
group of exact copies is one point, however large.

Pairs: a vantage-point tree, fitted on a bounded sample, cuts Hamming space into shards. A point
x at distance d from a vantage point with radius m can only have neighbours within r on the inner
side if d - r <= m, and on the outer side if d + r > m (triangle bounds); other branches are
pruned. Each point is a member of one shard and visits the shards across a boundary that it
overlaps; of two shards, the one with the larger number is visited, so every pair of points in
reach meets exactly once. A shard with more members than CHUNK is split into chunks by a hash and
visitors go to each chunk, so no task holds more than one chunk of members; visitors stream past.

Links: a chunk emits the edges of a spanning forest of what it saw, never all pairs of a group.
Components: alternating large-star and small-star contraction of those edges, a few joins a round. Hubs, and
fingerprints of many documents, meet their rows by broadcast: there are few of them, by counting.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm import common
from barline.llm.common import HEAVY_DOCUMENTS, durable, join_counted, remove, shared_folder, stored

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Members of a shard that the tree aims at, and most members of a chunk.
SHARD, CHUNK = 4096, 8192
#: Most shards of a tree, and points sampled for each; bounds the tree and what it is fitted on.
MOST_SHARDS, SAMPLE_PER_SHARD = 1 << 15, 16
#: Shingles whose bits are counted at a time.
SHINGLES_AT_ONCE = 1 << 16


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the 64-bit hashes, which come in parts; 0 if there are none."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str | None) -> int:
    """64 majority bits of the XXH64 hashes of the word shingles; 0 for a text without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    # On UTF-8 bytes, lower() changes A-Z only and split() cuts at space and tab to carriage return only.
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        return digest(b" ".join(words), SEED)
    parts = (words[start : start + SHINGLES_AT_ONCE + SHINGLE_WORDS - 1] for start in range(0, len(words) - SHINGLE_WORDS + 1, SHINGLES_AT_ONCE))
    return majority(np.array([digest(b"%b %b %b" % three, SEED) for three in zip(part, part[1:], part[2:], strict=False)], np.uint64) for part in parts)


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text as a long (the same 64 bits, signed)."""

    @F.arrow_udf("long")
    def of_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(into, of_texts(F.col(text)))


class Tree:
    """A vantage-point tree over 64-bit points; leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.point: list[int] = []
        self.radius: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.leaves = 0
        self._grow(np.asarray(sample, np.uint64), leaves)
        self.point = np.array(self.point, np.uint64)
        self.radius, self.left, self.right = (np.array(x, np.int64) for x in (self.radius, self.left, self.right))

    def _grow(self, sample: np.ndarray, leaves: int) -> int:
        node = len(self.point)
        for values in (self.point, self.radius, self.left, self.right):
            values.append(0)
        cut = self._cut(sample) if leaves > 1 and len(sample) > 1 else None
        if cut is None:
            self.left[node], self.right[node] = -1, self.leaves
            self.leaves += 1
            return node
        vantage, radius, inner = cut
        self.point[node], self.radius[node] = int(vantage), radius
        self.left[node] = self._grow(sample[inner], leaves // 2)
        self.right[node] = self._grow(sample[~inner], leaves - leaves // 2)
        return node

    @staticmethod
    def _cut(sample: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
        """Of some sample points, the one whose boundary fewest points overlap for an even cut."""
        best = None
        for vantage in sample[:: max(1, len(sample) // 8)][:8]:
            distance = np.bitwise_count(sample ^ vantage).astype(np.int64)
            radius = int(np.median(distance))
            if (distance <= radius).all():
                radius = int(distance.max()) - 1
            inner = distance <= radius
            if inner.all() or not inner.any():
                continue
            cost = (np.abs(distance - radius) <= RADIUS).mean() + abs(inner.mean() - 0.5)
            if best is None or cost < best[0]:
                best = cost, vantage, radius, inner
        return best and best[1:]

    def route(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The member's own shard of each point; and positions and shards of the visits to larger shards."""
        at = np.arange(len(points))
        node, own = np.zeros(len(points), np.int64), np.ones(len(points), bool)
        home, visits = np.zeros(len(points), np.int64), []
        while len(at):
            leaf = self.left[node] < 0
            shard = self.right[node[leaf]]
            home[at[leaf & own]] = self.right[node[leaf & own]]
            visits.append(np.stack([at[leaf], shard])[:, ~own[leaf]])
            at, node, own = at[~leaf], node[~leaf], own[~leaf]
            distance = np.bitwise_count(points[at] ^ self.point[node]).astype(np.int64)
            radius = self.radius[node]
            inner = distance <= radius
            into_left, into_right = distance - reach <= radius, distance + reach > radius
            at, node, own = (
                np.concatenate([at[into_left], at[into_right]]),
                np.concatenate([self.left[node[into_left]], self.right[node[into_right]]]),
                np.concatenate([(own & inner)[into_left], (own & ~inner)[into_right]]),
            )
        who, where = np.concatenate(visits, axis=1)
        later = where > home[who]
        return home, who[later], where[later]


def chunk_of(points: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """The chunk of each point in a shard of so many chunks."""
    mixed = points * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % chunks.astype(np.uint64)).astype(np.int64)


def spanning_edges(members: np.ndarray, label: np.ndarray, points: np.ndarray, first: int, reach: int) -> list[tuple[int, int]]:
    """Edges that join each point to the members within reach of it, but for those already joined.

    label: of each member, changed here; members with one label are joined by earlier edges.
    first: 0, or the position of the points among the members, each of which then meets later members only.
    """
    edges = []
    for start in range(0, len(points), 256):
        some = points[start : start + 256]
        near = np.bitwise_count(some[:, None] ^ members[None, :]) <= reach
        for row in np.flatnonzero(near.any(axis=1)):
            close = near[row]
            if first >= 0:
                close[: first + start + row + 1] = False
            found = np.flatnonzero(close)
            if not len(found):
                continue
            labels, at = np.unique(label[found], return_index=True)
            own = label[first + start + row] if first >= 0 else -1
            for one, position in zip(labels, found[at], strict=True):
                if one != own:
                    edges.append((int(some[row]), int(members[position])))
            joined = np.append(labels, own) if own >= 0 else labels
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined.min()
    return edges


def _edges_of_chunks(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, chunk and role; a chunk's members are kept until the next chunk starts."""
    key, members, label, done = None, [], None, False

    def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def finish() -> list[tuple[int, int]]:
        nonlocal members, label, done
        done = True
        members = np.concatenate(members) if members else np.zeros(0, np.uint64)
        label = np.arange(len(members))
        return spanning_edges(members, label, members, 0, reach)

    for batch in batches:
        shard, chunk, role, point = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        point = point.view(np.uint64)
        code = (shard << 32) | (chunk << 1) | role
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else []
        for start, stop in zip(starts, [*starts[1:], len(code)], strict=True):
            here = (int(shard[start]), int(chunk[start]))
            if here != key:
                if key is not None and not done and (edges := finish()):
                    yield out(edges)
                key, members, label, done = here, [], None, False
            if role[start] == 0:
                members.append(point[start:stop])
                continue
            edges = [] if done else finish()
            if len(members):
                edges += spanning_edges(members, label, point[start:stop], -1, reach)
            if edges:
                yield out(edges)
    if key is not None and not done and (edges := finish()):
        yield out(edges)


def links(points: DataFrame, reach: int = RADIUS) -> DataFrame:
    """(a, b) of distinct 64-bit points: edges whose components are those of all pairs within reach.

    points: one column, fingerprint, of distinct longs.
    """
    leaves = max(1, min(MOST_SHARDS, -(-points.count() // SHARD)))
    sample = np.zeros(0, np.int64)
    if leaves > 1:
        rows = points.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(leaves * SAMPLE_PER_SHARD)
        sample = rows.toPandas()["fingerprint"].to_numpy(np.int64)
    tree = Tree(sample.view(np.uint64), leaves)
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(shared.value.leaves, np.int64)
        for batch in batches:
            home, _, _ = shared.value.route(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), reach)
            counts += np.bincount(home, minlength=len(counts))
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["shard", "n"])

    sizes = points.mapInArrow(shards_of, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    chunks = np.ones(tree.leaves, np.int64)
    for row in sizes.collect():  # a row for each shard, MOST_SHARDS at most
        chunks[row["shard"]] = -(-row["n"] // CHUNK)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            point = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            home, who, where = shared.value.route(point, reach)
            own = chunk_of(point, chunks[home])
            # Visits: every chunk of the other shards, and the later chunks of the own one.
            who = np.concatenate([who, np.arange(len(point))])
            where = np.concatenate([where, home])
            from_chunk = np.where(np.arange(len(who)) < len(who) - len(point), 0, np.r_[np.zeros(len(who) - len(point), np.int64), own + 1])
            times = chunks[where] - from_chunk
            visitor = np.repeat(who, times)
            to_shard = np.repeat(where, times)
            to_chunk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(from_chunk, times)
            columns = [np.r_[home, to_shard], np.r_[own, to_chunk], np.r_[np.zeros(len(point), np.int64), np.ones(len(visitor), np.int64)], np.r_[point, point[visitor]].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shard", "chunk", "role", "fingerprint"])

    dealt = points.mapInArrow(routed, "shard long, chunk long, role long, fingerprint long")
    met = dealt.repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "role")
    return met.mapInArrow(lambda batches: _edges_of_chunks(batches, reach), "a long, b long")


def _size_unless_stars(edges: DataFrame) -> int:
    """The number of edges; 0 if they are a forest of stars: each a has one b, and no b is an a."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("below")), F.struct(F.col("b").alias("node"), F.lit(0).alias("below")))).alias("x"))
    nodes = ends.groupBy("x.node").agg(F.sum("x.below").alias("below"), F.min("x.below").alias("leaf"))
    found = nodes.agg(F.sum("below").alias("edges"), F.count(F.when((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("leaf") == 0)), 1)).alias("others")).first()
    return found["edges"] if found["others"] else 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of the edges: root is the smallest node that it is connected to.

    Large-star then small-star until a star is left of each component; the number of rounds grows with the
    logarithm of a component's size. A hub's neighbours are never gathered: least neighbours are aggregated,
    then joined, a hub's by broadcast. Rounds are written as Parquet, each removed once the next one is there: a checkpoint keeps
    Spark's estimate of its size, joins multiply these, and over a dozen rounds the number alone outgrew the driver's memory.
    """
    spark = edges.sparkSession
    folder, round_ = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}", 0

    def least(edges: DataFrame, total: int) -> DataFrame:
        """(a, m, n): of each a, its least b, or itself if that is less; and how many it has."""
        found = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        return durable(found) if total > common.HEAVY_ROWS else found

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/0")
    while total := _size_unless_stars(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = join_counted(both, least(both, 2 * total), "a", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        down = durable(down) if total > common.HEAVY_ROWS else down
        small = join_counted(down, least(down, total), "a", total).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        round_ += 1
        now = stored(small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct(), f"{folder}/{round_}")
        remove(spark, f"{folder}/{round_ - 1}")
    now = durable(now)
    remove(spark, folder)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, reach: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Fingerprints at most reach bits apart are linked; component_id is the smallest doc_id that can be
    reached over links, the row's own included. Null and empty texts have fingerprint zero and are linked
    like any other. Rows with a null doc_id link others; their component_id is null only if no row of the
    component has a doc_id. Repeated rows are returned each. An empty table gives no rows. Other columns
    of docs play no part.
    """
    marked = durable(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fingerprint"))
    distinct = durable(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    nodes = components(links(distinct.select("fingerprint"), reach))
    joined = durable(nodes.join(distinct, F.col("node") == F.col("fingerprint")).select("fingerprint", "root", "least_id"))
    smallest = joined.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    linked = join_counted(joined, durable(smallest), "root", joined.count()).select("fingerprint", "component_id", F.lit(True).alias("linked"))
    ids = distinct.join(linked, "fingerprint", "left").select(
        "fingerprint", "n", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id")
    )
    return join_counted(marked, durable(ids), "fingerprint", marked.count(), heavy_rows=HEAVY_DOCUMENTS).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
