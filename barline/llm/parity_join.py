"""N-gram Jaccard join through parity sketches: exact, without comparing whole sets of all candidates.

Sketches: a set's shingles are dealt to parts, and a part is 64 bits, each the parity of the shingles hashed to it. Shingles that two
sets share cancel, so the sketches differ in at most as many bits as the sets have shingles of their own. At a similarity of 0.9 that
is a nineteenth of both sizes at most; with one part more than that, some part is equal (pigeonhole). The number of parts goes by size
band: a set is a member of its own band, and visits the next one if a set there can be a partner.

1. Equal parts: (band, part, bits) are dealt by their hash; those of one set only are dropped. Very frequent ones, found on a sample of
   the documents, aren't dealt at all, since they stay in any case.
2. Search: buckets are searched for pairs whose shorter parity sketches are near enough; a spanning forest of these is given.
3. Verify: those pairs are compared on whole sets, and what is alike is joined. Buckets where one of them isn't alike after all, and
   that still hold several components, are searched again without the shortcut, until nothing was held back.

Copies of one set are one node. A bucket is searched in chunks of bounded size, which later chunks' sets visit. A set of which many are
compared meets them in salted groups.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import durable, join_counted
from barline.llm.near_copies import name_components, node_of, shingle_hashes
from barline.llm.simhash import components

SHINGLE_WORDS = 3
#: The least similarity of a link, in hundredths.
SIMILAR = 90
#: Largest size of a band by its smallest, and the least words (of 64 bits) of the sketches that pairs of a bucket are compared by.
BAND_RATIO, SKETCH_WORDS = 1.5, 4
#: Rows, shingles and keys that a task gives out at a time.
ROWS_AT_ONCE, VALUES_AT_ONCE = 2048, 1 << 18
#: So many ends of edges to be verified go to the texts by broadcast; more are joined by a shuffle.
FEW = 1_000_000
#: Sets of a chunk of a bucket, about, and sets that meet one copy of a set that many are compared with.
CHUNK, HUB = 4096, 1000
#: Pairs that a set gives at most with one component in the first search without the shortcut; each search after that allows as many times more.
PAIRS = 64
#: One in so many documents is sampled for frequent keys; a key of more than this share of the sampled rows is frequent.
SAMPLE, FREQUENT = 16, 1 / 2000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def apart(a: int, b: int) -> int:
    """Most shingles that two linked sets of these sizes have of their own."""
    # 100 i >= S u, where i = (a + b - own) / 2 and u = (a + b + own) / 2
    return (100 - SIMILAR) * (a + b) // (100 + SIMILAR)


@lru_cache
def starts(upto: int) -> tuple[int, ...]:
    """Smallest sizes of the bands, through the first one above upto."""
    found = [1]
    while found[-1] <= upto:
        found.append(max(found[-1] + 1, int(found[-1] * BAND_RATIO)))
    return tuple(found)


def bands_of(size: int) -> list[tuple[int, int]]:
    """(band, parts) of the bands where a set takes part: its own, and those of larger sets that it can be linked with; own first."""
    largest = size * 100 // SIMILAR
    edges = starts(1 << max(1, largest).bit_length())
    own, last = bisect_right(edges, size) - 1, bisect_right(edges, largest) - 1
    pairs = []
    for band in range(own, last + 1):
        most = edges[band + 1] - 1
        if differing := apart(most, most):  # else only equal sets are linked, and these are one node
            pairs.append((band, differing + 1))
    return pairs


def parities(hashes: np.ndarray, words: int) -> np.ndarray:
    """words x 64 bits: the parity of the shingles that are hashed to each."""
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, ((hashes >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)).astype(np.int64), np.uint64(1) << (hashes & np.uint64(63)))
    return out


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """A power of two of words, with a bit for each shingle about."""
    return parities(hashes, max(SKETCH_WORDS, 1 << (len(hashes) // 64).bit_length()))


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of so many words (a power of two) that the set would have."""
    while sketch.shape[-1] > words:
        sketch = sketch[..., ::2] ^ sketch[..., 1::2]
    return sketch


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each part of each band of a set."""
    out = [np.zeros(0, np.uint64)]
    for band, parts in bands_of(len(hashes)) if len(hashes) else []:
        keys = (parities(hashes, parts) ^ np.uint64(band)) * _ODD
        keys = (keys ^ (keys >> np.uint64(32)) ^ np.arange(parts, dtype=np.uint64)) * _ODD
        out.append(keys ^ (keys >> np.uint64(29)))
    return np.concatenate(out)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) for x in found)]), pa.int32()), pa.array(flat))


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, node (hash of the set), n_shingles, sketch and keys of each row; of rows of one set in a batch, the first one has the keys."""
    kinds = "node long, n_shingles long, sketch array<long>, keys array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            seen: set[int] = set()
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                nodes, sizes, sketches, keys = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64), [], []
                for i, text in enumerate(batch.column(1)):
                    hashes = shingle_hashes(text.as_py(), SHINGLE_WORDS)
                    nodes[i], sizes[i] = node_of(hashes), len(hashes)
                    sketches.append(sketch_of(hashes))
                    keys.append(np.zeros(0, np.uint64) if int(nodes[i]) in seen else keys_of(hashes))
                    seen.add(int(nodes[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes.view(np.int64)), pa.array(sizes), _lists(sketches), _lists(keys)], names=["doc_id", "node", "n_shingles", "sketch", "keys"])

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, shingles) of the texts; a set that comes again in a batch isn't given again."""
    for batch in batches:
        found: dict[int, np.ndarray] = {}
        seen, held = set(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.array(list(found), np.uint64).view(np.int64)), _lists(list(found.values()))], names=["node", "shingles"])  # noqa: B023

        for text in batch.column(0):
            hashes = shingle_hashes(text.as_py(), SHINGLE_WORDS)
            node = node_of(hashes)
            if node not in seen:
                seen.add(node)
                found[node], held = hashes, held + len(hashes)
            if held > VALUES_AT_ONCE:
                yield out()
                found, held = {}, 0
        if found:
            yield out()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node), sorted, each once, and only those whose key has several nodes. One row is held back from batch to batch."""
    last, alone = None, True
    for batch in batches:
        key, node = (batch.column(i).to_numpy() for i in range(2))
        if last is not None:
            key, node = np.r_[last[0], key], np.r_[last[1], node]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[fresh], node[fresh]
        if not len(key):
            continue
        same = np.r_[last is not None and not alone, key[1:] == key[:-1]]  # as the one before it
        keep = same | np.r_[key[1:] == key[:-1], False]
        last, alone = (key[-1], node[-1]), not same[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep[:-1]]) for x in (key, node)], names=["key", "node"])
    if last is not None and not alone:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([x])) for x in last], names=["key", "node"])


def buckets(signed: DataFrame) -> DataFrame:
    """(key, node) of the keys that several sets have."""
    keyed = signed.select(F.explode("keys").alias("key"), "node")
    sample = signed.where(F.pmod(F.xxhash64("doc_id", "node"), F.lit(SAMPLE)) == 0).select(F.explode("keys").alias("key"), "node")
    counts = durable(sample.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1"))
    total = signed.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0] / SAMPLE
    # At most 1 / FREQUENT keys. They have several nodes, so they need no dealing to be known for that.
    frequent = F.broadcast(counts.where((F.col("low") != F.col("high")) & (F.col("n") > F.greatest(F.lit(total * FREQUENT), F.lit(1000)))).select("key"))
    rest = keyed.join(frequent, "key", "left_anti").repartition("key").sortWithinPartitions("key", "node")
    return rest.mapInArrow(_shared, "key long, node long").unionByName(keyed.join(frequent, "key", "left_semi").distinct())


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, side, b, shingles) come sorted by the first three: a set, then those that it is compared with."""
    now, one = None, None
    for batch in batches:
        a, part, side = (batch.column(i).to_numpy() for i in range(3))
        b = batch.column(3).fill_null(0).to_numpy()
        lists = batch.column(4)
        ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        found: tuple[list, list, list] = ([], [], [])
        for i in range(len(a)):
            other = flat[ends[i] : ends[i + 1]]
            if (a[i], part[i]) != now:
                now, one = (a[i], part[i]), other.copy()
            if side[i]:
                both = int(np.count_nonzero(one[np.minimum(np.searchsorted(one, other), len(one) - 1)] == other))
                for column, value in zip(found, (a[i], b[i], 100 * both >= SIMILAR * (len(one) + len(other) - both)), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.bool_())], names=["a", "b", "linked"])


def alike(edges: DataFrame, docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Edges (a, b) with `linked`: whether the whole sets are SIMILAR. Each set is dealt once for each edge, and once for each group it meets."""
    edges = durable(edges.distinct())
    counts = durable(edges.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / HUB)))
    dealt = join_counted(edges, counts, "a", edges.count()).select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.lit(1).alias("side"), "b")
    hubs = counts.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("b"))
    ends = durable(dealt.unionByName(hubs))
    nodes = ends.select("node").distinct()
    least = durable(signed.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("least_id")).select("least_id").distinct())
    few = ends.count() <= FEW  # there are no more doc_ids than ends
    ends, least = (F.broadcast(ends), F.broadcast(least)) if few else (ends, least)
    texts = docs.join(least, F.col("doc_id").eqNullSafe(F.col("least_id")), "left_semi")
    # A document of several texts can bring a set that another one has brought; both are the same.
    met = texts.select("text").mapInArrow(_sets, "node long, shingles array<long>").join(ends, "node").select("a", "part", "side", "b", "shingles")
    return met.repartition("a", "part").sortWithinPartitions("a", "part", "side").mapInArrow(_judged, "a long, b long, linked boolean").distinct()


class Bucket:
    """The sets of a chunk of a bucket, by node."""

    def __init__(self, nodes: np.ndarray, roots: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], most: int | None):
        order = np.argsort(nodes, kind="stable")
        self.nodes, self.sizes, self.most = nodes[order], sizes[order], most
        self.words = min(map(len, sketches))
        self.sketches = {self.words: np.stack([folded(sketches[i], self.words) for i in order])}
        self.label = np.unique(roots[order], return_inverse=True)[1]
        self.names = np.unique(roots)

    def meet(self, node: int, root: int, size: int, sketch: np.ndarray, after: int) -> list[tuple[int, int, bool]]:
        """Edges between a set and those from position `after` on that may be linked with it and are of another component, and
        whether others were held back. Without a limit, one of each component; the component then counts as the set's."""
        place = np.searchsorted(self.names, root)
        own = self.label[after - 1] if after else place if place < len(self.names) and self.names[place] == root else -1
        others = np.flatnonzero(self.label[after:] != own) + after
        low, high = np.minimum(self.sizes[others], size), np.maximum(self.sizes[others], size)
        words = min(self.words, len(sketch))
        if words not in self.sketches:
            self.sketches[words] = folded(self.sketches[self.words], words)
        near = np.bitwise_count(self.sketches[words][others] ^ folded(sketch, words)).sum(axis=1) <= (100 - SIMILAR) * (low + high) // (100 + SIMILAR)
        others = others[near & (100 * low >= SIMILAR * high)]
        if not len(others):
            return []
        labels, at, counts = np.unique(self.label[others], return_index=True, return_counts=True)
        if self.most is None:
            joined = np.append(labels, own) if own >= 0 else labels
            found = [(node, int(self.nodes[others[i]]), False) for i in at]
            self.label[np.isin(self.label, joined)] = joined.min()
            return found
        order = np.argsort(self.label[others], kind="stable")
        rank = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        held = bool((counts > self.most).any())
        return [(node, int(self.nodes[i]), held) for i in others[order[rank < self.most]]]

    def own(self) -> list[tuple[int, int, bool]]:
        return [edge for i in range(len(self.nodes) - 1) for edge in self.meet(int(self.nodes[i]), -1, int(self.sizes[i]), self.sketches[self.words][i], i + 1)]


def _near(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (key, chunk, visits, node, root, size, sketch) come sorted by the first three: a chunk's sets, which are kept, then visitors."""
    now, parts, bucket = None, [], None

    def closed() -> list[tuple[int, int, int, bool]]:
        nonlocal bucket, parts
        bucket = Bucket(*(np.concatenate([part[i] for part in parts]) for i in range(3)), [x for part in parts for x in part[3]], most) if parts else None
        parts = []
        return [(now[0], *edge) for edge in bucket.own()] if bucket else []

    def out(edges: list[tuple[int, int, int, bool]]) -> pa.RecordBatch:
        columns = list(zip(*edges, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(column, pa.int64()) for column in columns[:3]), pa.array(columns[3], pa.bool_())], names=["key", "a", "b", "held"])

    for batch in batches:
        key, chunk, visits, node, root, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        lists = batch.column(6)
        ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64).copy()
        sketch = [flat[low:high] for low, high in zip(ends, ends[1:], strict=False)]
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]) | (visits[1:] != visits[:-1])]) if len(key) else []
        edges: list[tuple[int, int, int, bool]] = []
        for start, stop in zip(cuts, [*cuts[1:], len(key)], strict=True):
            here = (key[start], chunk[start])
            if here != now:
                edges += closed()
                now, bucket = here, None
            if not visits[start]:
                parts.append((node[start:stop], root[start:stop], size[start:stop], sketch[start:stop]))
                continue
            edges += closed() if parts else []
            for i in range(start, stop) if bucket else ():
                edges += [(now[0], *edge) for edge in bucket.meet(int(node[i]), int(root[i]), int(size[i]), sketch[i], 0)]
        if edges:
            yield out(edges)
    if edges := closed():
        yield out(edges)


def _searched(rows: DataFrame, roots: DataFrame, sketched: DataFrame, most: int | None) -> DataFrame:
    """(key, a, b, held): pairs that may be linked, from the buckets (rows: key, node) that hold several components."""
    named = durable(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    mixed = named.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    mixed = durable(mixed.select("key", "n", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    if mixed.isEmpty():
        return named.select("key", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(False).alias("held")).limit(0)
    left = join_counted(named, mixed, "key", named.count()).join(sketched, "node")
    chunk = F.pmod(F.xxhash64("node"), "chunks").cast("int")
    met = left.withColumn("own", chunk).withColumn("chunk", F.explode(F.sequence("own", F.col("chunks") - 1)))
    met = met.select("key", "chunk", (F.col("chunk") != F.col("own")).cast("int").alias("visits"), "node", "root", "size", "sketch")
    found = met.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "visits").mapInArrow(lambda batches: _near(batches, most), "key long, a long, b long, held boolean")
    return found.select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "held")


def _once(rows: DataFrame) -> DataFrame:
    """Of buckets (key, node) that hold the same sets, as those of near copies mostly do, one."""
    marks = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"mark_{seed}") for seed in range(2)]
    members = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), *marks)
    kept = durable(members.groupBy("n", "low", "high", "mark_0", "mark_1").agg(F.min("key").alias("key")).select("key", "n"))
    return join_counted(rows, kept, "key", rows.count())


def links(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(node, root) of the sets with a link; docs: doc_id, text; signed: _signed of the same rows with shingles."""
    rows = durable(_once(durable(buckets(signed))))
    sketched = durable(signed.join(rows.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch")))
    spark, most = docs.sparkSession, None
    judged, roots = spark.createDataFrame([], "a long, b long, linked boolean"), spark.createDataFrame([], "node long, root long")
    while True:
        pairs = durable(_searched(rows, roots, sketched, most))
        fresh = durable(alike(pairs.select("a", "b").distinct().join(judged, ["a", "b"], "left_anti"), docs, signed))
        judged = fresh if most is None else durable(judged.unionByName(fresh))
        roots = durable(components(judged.where("linked").select("a", "b")))
        # A forest can have hidden links only in buckets where one of its edges failed; without that shortcut, where pairs were held back.
        again = pairs.join(fresh.where("not linked"), ["a", "b"], "left_semi") if most is None else pairs.where("held")
        again = durable(again.select("key").distinct())
        if again.isEmpty():
            return roots
        rows = durable(rows.join(again, "key", "left_semi"))
        most = PAIRS if most is None else most * PAIRS


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest doc_id that can be reached over pairs of texts whose sets of
    SHINGLE_WORDS-word shingles have a Jaccard similarity of SIMILAR hundredths or more.

    A-Z are lower-cased. A text of fewer words is one shingle. Null texts and texts without words have no shingles and no links: the
    component is their own doc_id. Rows without a doc_id link others; their component_id is null only if no row of the component has
    one. Repeated rows are returned each; an empty table gives no rows. Other columns play no part. Sets are compared by 64-bit hashes
    of their shingles, and known by a 64-bit hash of these.
    """
    docs = docs.select("doc_id", "text")
    signed = durable(_signed(docs))
    full = signed.where("n_shingles > 0")
    named = name_components(full.select("doc_id", "node", "n_shingles"), links(docs, full)).select("doc_id", "n_shingles", "component_id")
    return named.unionByName(signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
