"""Near copies by SimHash, then by the words that texts share: the near-dedup stage of the pipeline.

A link is a Jaccard similarity of the sets of five-word shingles of 0.8 or more; whole sets decide on it.

Candidates: texts with one set are one node. Each node has a SimHash fingerprint, the majority bits of its shingles; those RADIUS
or fewer bits apart are found through the vantage-point tree of `simhash`, as op4 finds its links. Texts of which a fifth differs
lie beyond any radius that a tree can search, so nodes that share the key of a band (the least values of a few permutations of the
set) are candidates too. Over all of these they form clusters. Nothing is compared across clusters.

Links: a cluster is cut into blocks of bounded size, and each pair of its blocks is a task's work: pairs beyond RADIUS are ruled out
by sketches, and the others are compared on their whole sets. A pair of blocks gives the edges of a spanning forest of what it saw, never all
pairs; components of the edges are the groups. So a cluster with a third of all nodes is many small pieces of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm import simhash
from barline.llm.common import HEAVY_DOCUMENTS, durable, join_counted, quoted
from barline.llm.simhash import RADIUS, SEED, components

#: Words of a shingle, and the least Jaccard similarity of a link (a fraction).
SHINGLE_WORDS, SIMILAR = 5, (4, 5)
#: Bands of a text and least values in a band's key: a pair at 0.8 shares none with a chance of (1 - 0.8^5)^20, 0.04 %.
BANDS, BAND_ROWS = 20, 5
#: Bits in which the sketches (two bits of each least value) of a pair may differ: 20 are expected at 0.8, with a deviation of 5.1.
SKETCH_APART = 38
#: Nodes of a block, about: at least, at most, and in between as many as make FEW_BLOCKS of a cluster; and most shingles of a block, about.
LEAST_BLOCK, MOST_BLOCK, FEW_BLOCKS, BLOCK_SHINGLES = 256, 4096, 64, 1 << 20
#: So many doc_ids go to the documents by broadcast; more are joined by a shuffle.
FEW = 1_000_000
#: Words whose hashes a worker keeps at most, but for those of one text.
WORDS_KNOWN = 1 << 16
#: Shingles compared with one set at a time.
SHINGLES_AT_ONCE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FLIPS, _FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64) | np.uint64(1)


class _Known(dict):
    """Hashes by word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


_known = _Known()


def shingle_hashes(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of so many words; A-Z are lower-cased, words end at space and \\t to \\r.

    A text of fewer words is one shingle; one without words has none. Sets are compared by these hashes, so two
    shingles count as one only if 64 bits collide within a pair of texts.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_known) > WORDS_KNOWN:
        _known.clear()
    hashes = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    n, wide = max(1, len(words) - shingle_words + 1), min(shingle_words, len(words))
    mixed = np.full(n, wide, np.uint64)
    for k in range(wide):
        mixed = (mixed ^ hashes[k : k + n]) * _ODD
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def node_of(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set: 64 majority bits of its hashes."""
    return simhash.majority(hashes[start : start + simhash.SHINGLES_AT_ONCE] for start in range(0, len(hashes), simhash.SHINGLES_AT_ONCE))


def bands_and_sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key for each band, of the least values of BAND_ROWS permutations of the set; and the sketch of all, four words."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 1024):
        some = hashes[start : start + 1024, None] ^ _FLIPS
        some *= _FACTORS
        some ^= some >> np.uint64(32)
        some *= _ODD
        np.minimum(least, some.min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ row) * _ODD
        keys ^= keys >> np.uint64(31)
    bits = np.zeros(256, np.uint8)
    bits[: 2 * len(least)] = np.concatenate([least & np.uint64(1), least >> np.uint64(1) & np.uint64(1)])
    return keys, np.packbits(bits).view(np.uint64)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, node (hash of the set of shingles), size of the set, fingerprint, band keys and sketch of each row."""

    @F.arrow_udf("struct<node:long,size:int,fingerprint:long,bands:array<long>,sketch:array<long>>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            nodes, sizes, prints = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int32), np.zeros(len(texts), np.uint64)
            bands, sketches = np.zeros((len(texts), BANDS), np.uint64), np.zeros((len(texts), 4), np.uint64)
            for i, text in enumerate(texts):
                hashes = shingle_hashes(text.as_py())
                nodes[i], sizes[i], prints[i] = node_of(hashes), len(hashes), fingerprint(hashes)
                bands[i], sketches[i] = bands_and_sketch(hashes)
            lists = [pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * x.shape[1], x.reshape(-1).view(np.int64)) for x in (bands, sketches)]
            yield pa.StructArray.from_arrays([pa.array(nodes.view(np.int64)), pa.array(sizes), pa.array(prints.view(np.int64)), *lists], names=["node", "size", "fingerprint", "bands", "sketch"])

    return docs.select("doc_id", sign(F.col("text")).alias("s")).select("doc_id", "s.*")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, shingles) of texts, some SHINGLES_AT_ONCE shingles at a time; a set that comes again in a batch isn't given again."""
    for batch in batches:
        seen: set[int] = set()
        nodes, sets, held = [], [], 0

        def out() -> pa.RecordBatch:
            flat, ends = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64), np.cumsum([0, *map(len, sets)])  # noqa: B023
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            return pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), lists], names=["node", "shingles"])  # noqa: B023

        for text in batch.column(0):
            hashes = shingle_hashes(text.as_py())
            node = node_of(hashes)
            if node not in seen:
                seen.add(node)
                nodes.append(node)
                sets.append(hashes)
                held += len(hashes)
            if held > SHINGLES_AT_ONCE // 4:
                yield out()
                nodes, sets, held = [], [], 0
        if nodes:
            yield out()


class Pair:
    """The members of two blocks (or of one, met with itself) of a cluster."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.sides: list[int] = []
        self.prints: list[int] = []
        self.sketches: list[np.ndarray] = []
        self.sets: list[np.ndarray] = []

    def add(self, node: int, side: int, fingerprint: int, sketch: np.ndarray, shingles: np.ndarray) -> None:
        self.nodes.append(node)
        self.sides.append(side)
        self.prints.append(fingerprint)
        self.sketches.append(sketch.view(np.uint64))
        self.sets.append(np.sort(shingles))

    def edges(self) -> list[tuple[int, int]]:
        """A spanning forest of the links between the blocks; in one block, of all its links."""
        n = len(self.nodes)
        if n < 2:
            return []
        sides, sketches, sizes = np.array(self.sides), np.stack(self.sketches), np.array([len(x) for x in self.sets])
        prints = np.array(self.prints, np.int64).view(np.uint64)
        label, edges = np.arange(n), []
        above, below = SIMILAR
        alone = not sides.any()
        for at in range(n if alone else np.count_nonzero(sides == 0)):
            # Side 0 comes first. Each member meets later members of its own block, or all of the other one, but not those joined with it.
            others = np.arange(at + 1, n) if alone else np.flatnonzero(sides)
            apart = np.bitwise_count(sketches[others] ^ sketches[at]).sum(axis=1)
            fits = (apart <= SKETCH_APART) | (np.bitwise_count(prints[others] ^ prints[at]) <= RADIUS)
            fits &= np.minimum(sizes[others], sizes[at]) * below >= np.maximum(sizes[others], sizes[at]) * above
            others = others[fits & (label[others] != label[at])]
            while len(others):
                through = max(1, int(np.searchsorted(np.cumsum(sizes[others]), SHINGLES_AT_ONCE, "right")))
                some, others = others[:through], others[through:]
                shared = self._shared(at, some)
                for other in some[shared * below >= (sizes[some] + sizes[at] - shared) * above]:
                    if label[other] != label[at]:
                        edges.append((self.nodes[at], self.nodes[other]))
                        label[label == label[other]] = label[at]
        return edges

    def _shared(self, at: int, others: np.ndarray) -> np.ndarray:
        """How many shingles each of the others has in common with one member."""
        own, sizes = self.sets[at], [len(self.sets[other]) for other in others]
        if not len(own):
            return np.zeros(len(others), np.int64)
        flat = np.concatenate([self.sets[other] for other in others])
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        found = np.concatenate([[0], np.cumsum(own[place] == flat)])
        ends = np.cumsum(sizes)
        return found[ends] - found[ends - sizes]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, low, high, side, node, fingerprint, sketch, shingles) come sorted by the first four; a pair of blocks is kept until the next one starts."""
    key, pair = None, Pair()

    def out() -> pa.RecordBatch:
        found = np.array(pair.edges(), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        side, node, prints = (batch.column(i).to_pylist() for i in (3, 4, 5))
        lists = []
        for i in (6, 7):
            column = batch.column(i)
            ends, flat = column.offsets.to_numpy() - column.offsets[0].as_py(), column.flatten().to_numpy(zero_copy_only=False)
            lists.append([flat[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        for row, here in enumerate(keys):
            if here != key:
                if len(pair.nodes) > 1:
                    yield out()
                key, pair = here, Pair()
            pair.add(node[row], side[row], prints[row], lists[0][row], lists[1][row].copy())
    if len(pair.nodes) > 1:
        yield out()


def in_reach(distinct: DataFrame) -> DataFrame:
    """(node, band): a key of one more band for nodes whose fingerprints are RADIUS or fewer bits apart, or reach each other over others."""
    points = durable(distinct.groupBy("fingerprint").agg(F.count("*").alias("n")))
    roots = components(simhash.links(points.select("fingerprint"), RADIUS)).select(F.col("node").alias("fingerprint"), "root")
    found = points.join(roots, "fingerprint", "left").where("root is not null or n > 1")
    keys = durable(found.select("fingerprint", F.xxhash64(F.coalesce("root", "fingerprint")).alias("band"), "n"))
    return join_counted(distinct.select("node", "fingerprint"), keys, "fingerprint", distinct.count()).select("node", "band")


def links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b): edges between nodes at SIMILAR or more, whose components are those of all such pairs among the candidates."""
    banded = distinct.select("node", F.explode("bands").alias("band")).union(durable(in_reach(distinct)))
    heads = durable(banded.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1"))
    stars = join_counted(banded, heads, "band", (BANDS + 1) * distinct.count()).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    clusters = durable(components(stars))
    members = durable(clusters.join(distinct.drop("bands"), "node"))
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    block = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.col("n") / FEW_BLOCKS))
    sizes = sizes.withColumn("blocks", F.ceil(F.greatest(F.col("n") / block, F.col("shingles") / BLOCK_SHINGLES)).cast("int")).drop("shingles")
    members = join_counted(members, durable(sizes), "root", members.count())
    wanted = members.select("node", "root", "blocks", "fingerprint", "sketch")
    texts, least = docs.select("doc_id", "text"), members.select("least_id").distinct()
    # Each row of a wanted doc_id is shingled once, whatever number of texts that doc_id has; of the rows of one set one is needed.
    texts = texts.join(least, F.col("doc_id").eqNullSafe(F.col("least_id")), "left_semi").select("text")
    sets = texts.mapInArrow(_sets, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = sets.join(wanted, "node").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "fingerprint", "sketch", "shingles"
    )
    met = met.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "side")
    return met.mapInArrow(_edges, "a long, b long")


def name_components(signed: DataFrame, roots: DataFrame) -> DataFrame:
    """signed (doc_id, node, ...) with the component's doc_id and node of the row that comes first, by doc_id (null last), then node:
    component_id, component_node.

    roots: (node, root) of the nodes with a link; other nodes are components of their own. signed had better be durable.
    """
    order = F.struct(F.col("least_id").isNull(), "least_id", "node")
    distinct = signed.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows"))
    joined = durable(distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = joined.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    least = least.select("root", F.col("first.least_id").alias("component_id"), F.col("first.node").alias("component_node"), "n")
    named = join_counted(joined.select("node", "root", "rows"), durable(least), "root", joined.count()).drop("root").withColumnRenamed("rows", "n")
    return join_counted(signed, durable(named), "node", signed.count(), heavy_rows=HEAVY_DOCUMENTS)


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, node, component_id and component_node of every row."""
    docs = docs.select("doc_id", "text")
    signed = durable(_signed(docs))
    firsts = [F.first(name).alias(name) for name in ("size", "fingerprint", "bands", "sketch")]
    distinct = durable(signed.groupBy("node").agg(F.min("doc_id").alias("least_id"), *firsts))
    return name_components(signed.select("doc_id", "node"), durable(components(links(docs, distinct))))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of the rows of docs (doc_id, text): the smallest doc_id that can be reached over pairs of texts whose
    sets of SHINGLE_WORDS-word shingles have a Jaccard similarity of SIMILAR or more.

    Texts without words are copies of one another. Rows without a doc_id link others; their component_id is null only if no row of
    the component has one. Repeated rows are returned each; an empty table gives no rows.
    """
    return _named(docs).select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of near_copies: of its rows with the smallest doc_id (null comes last), that with the least node.

    So each text stays or has a near copy that does, whatever doc_ids rows share. Of rows with one doc_id and one set of shingles, the
    one with the least text stays, of equal texts the one with the least hash of all columns. Columns are kept, whatever their names.
    An empty table gives no rows.
    """

    @F.arrow_udf("long")
    def node(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([node_of(shingle_hashes(text.as_py())) for text in texts], np.uint64).view(np.int64))

    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("node") == F.col("component_node"))
    found = durable(_named(docs).groupBy("doc_id", "node").agg(F.count("*").alias("rows"), F.max(first).alias("stays")))
    of_id = found.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("texts"), F.sum("rows").alias("rows"), F.max("stays").alias("stays"))
    # Those that go, are there more than once, or have several texts, which are told apart by their nodes.
    odd = durable(of_id.where("texts > 1 or rows > 1 or not stays"))
    odd = F.broadcast(odd) if odd.count() <= FEW else odd
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    alone = docs.join(odd, same, "left_anti").select(F.struct("*").alias("row"))
    hashed = [F.col(quoted(name)) for name, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    several = docs.join(odd.where("stays and (texts > 1 or rows > 1)").select("__id"), same, "left_semi")
    marked = several.select("doc_id", node("text").alias("node"), F.struct(F.col("text"), F.xxhash64(*hashed)).alias("order"), F.struct("*").alias("row"))
    staying = found.where("stays").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node"))
    repeated = marked.join(staying, same & (F.col("node") == F.col("__node")), "left_semi").groupBy("doc_id", "node").agg(F.min_by("row", "order").alias("row")).select("row")
    return alone.union(repeated).select("row.*")
