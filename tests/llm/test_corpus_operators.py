"""Top-k search, SimHash near-dedup, sharding, mixing, URL filter, HTML extraction."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import url_models
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from barline.llm import common, html_extract, mixing, near_copies, queries, sharding, simhash, topk, url_filter
from barline.llm.common import durable

# Top-k search


def brute_top(rows, k=10):
    def ints(v):
        return None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(1024 * float(x))) for x in v]

    usable = [(i, ints(v)) for i, v in rows if i is not None and ints(v)]
    out = set()
    for q, a in usable:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(a) == len(b))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def search(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("mine")).withColumn("rank", F.lit("mine"))
    return {tuple(r) for r in topk.search(df.repartition(3), F.col("vec_id") % 100 == 0, **kw).collect()}


def test_search_as_sql(spark, duck):
    assert len(same_rows(spark, duck, queries.QUERIES["op2_topk"], queries.ORACLE_SQL["op2_topk"])) == 50


def test_search_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(0, 700, 2)]
    rows += [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(1000, 1150, 5)] + [(7, rows[3][1]), (7, rows[3][1])]
    want = brute_top(rows)
    found = search(spark, rows)
    assert found == want
    monkeypatch.setattr(topk, "GROUP_ROWS", 16)
    monkeypatch.setattr(topk, "GROUP_VALUES", 100)
    assert search(spark, rows) == want


@pytest.mark.parametrize("size", [1e4, 1e6, 1e12, 1e30])
def test_search_takes_vectors_of_any_size(spark, size):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * (size if i % 3 else 1.0)).tolist()) for i in range(0, 300, 5)]
    if size == 1e30:  # only scores that fit a long can be returned
        rows = [(i, [v[0] if i % 10 else 0.0, 0.0 if i % 10 else v[1] / size, *([0.0] * 4)]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = {tuple(r) for r in topk.search(df, F.col("vec_id") % 100 == 0).collect()} if size < 1e10 or size == 1e30 else None
    if found is not None:
        assert found == brute_top(rows)
    else:  # scores of about 10^30 don't fit
        with pytest.raises(Exception, match="long|int64|too (big|large)"):
            topk.search(df, F.col("vec_id") % 100 == 0).collect()


def test_search_of_wide_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4096) * 1000).astype(np.float32).tolist()) for i in range(0, 400, 10)]
    assert search(spark, rows) == brute_top(rows)


def test_bounds_save_products_and_lose_no_pair():
    rng = np.random.default_rng(3)
    decay = 1 / (1 + np.arange(64))
    vectors = rng.normal(size=(3000, 64)) * rng.permutation(decay)
    rows = topk.Block(np.arange(3000), vectors)
    asked = topk.Block(np.arange(0, 3000, 100), vectors[::100], rows.order)
    score = np.floor(1024 * vectors[::100]) @ np.floor(1024 * vectors).T
    score[np.arange(30), np.arange(0, 3000, 100)] = -np.inf
    low = np.sort(score, axis=1)[:, -10]
    at, to, products = topk.in_reach(asked, rows, low)
    assert {tuple(x) for x in np.argwhere(score >= low[:, None])} <= set(zip(at.tolist(), to.tolist()))
    assert products < 0.4 * score.size * 64 and len(at) < 0.02 * score.size
    assert topk.exact(asked, rows, at, to).tolist() == score[at, to].tolist()
    everything = topk.in_reach(asked, rows, np.full(30, -np.inf))
    assert len(everything[0]) == score.size - 30 and everything[2] == score.size * 64


def test_search_with_ties_nulls_and_few_rows(spark):
    same = [(i, [1.0, 0.5]) for i in range(0, 130)]
    assert search(spark, same) == brute_top(same)
    odd = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [-1.0, -1.0]), (6, [3.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0]), (200, None)]
    assert search(spark, odd) == brute_top(odd)
    assert search(spark, []) == set() and search(spark, [(1, [1.0])]) == set() and search(spark, [(100, [1.0])]) == set()
    assert search(spark, [(0, [1.0]), (100, [-2.0])]) == {(0, 1, 100, -2097152), (100, 1, 0, -2097152)}


# SimHash


def brute_components(texts):
    prints = [simhash.fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return prints, [find(i) for i in range(len(texts))]


def plain_fingerprint(text):
    import xxhash

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def near_texts(n):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    texts = [None, "", " \n", "A b", "a B", "one", "É é x y z", "a\x0bb c", "x" * 100_000]
    for _ in range(n):
        words = [rng.choice(base) for _ in range(60)]
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 3])):
            copy = list(words)
            copy[rng.randrange(60)] = rng.choice(base)
            texts.append(" ".join(copy))
    return texts + texts[9:30]


def test_fingerprints():
    for text in near_texts(20):
        assert simhash.fingerprint(text) == plain_fingerprint(text or "")
    whole = "a b c d e f g " * 50
    assert simhash.fingerprint(whole) == plain_fingerprint(whole)


@pytest.mark.parametrize(("shard", "chunk"), [(4096, 8192), (16, 8), (64, 20)])
def test_components_by_brute_force(spark, monkeypatch, shard, chunk):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    texts = near_texts(150)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(df.repartition(4)).collect()}
    prints, roots = brute_components(texts)
    for i in range(len(texts)):
        assert (rows[i]["fingerprint"], rows[i]["component_id"]) == (f"{prints[i]:016x}", roots[i])


def test_dense_cluster_emits_a_forest(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 50)
    monkeypatch.setattr(simhash, "CHUNK", 30)
    points = sorted({(1 << a) | (1 << b) for a in range(24) for b in range(24)})
    df = spark.createDataFrame([(p,) for p in points], "fingerprint long")
    edges = simhash.links(df)
    assert edges.count() < 30 * len(points)
    assert simhash.components(edges).select("root").distinct().count() == 1


def test_every_pair_in_reach_meets():
    rng = np.random.default_rng(1)
    points = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    flipped = points ^ (np.uint64(1) << rng.integers(0, 63, len(points)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, len(points)).astype(np.uint64))
    points = np.unique(np.concatenate([points, flipped]))
    tree = simhash.Tree(points, 32)
    home, who, where = tree.route(points, 2)
    there = defaultdict(set)
    for w, s in zip(who, where):
        there[w].add(s)
    for i in range(len(points)):
        for j in range(i):
            if int(points[i] ^ points[j]).bit_count() <= 2 and home[i] != home[j]:
                low, high = (i, j) if home[i] < home[j] else (j, i)
                assert home[high] in there[low] and home[low] not in there[high]


def test_hubs_meet_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_ROWS", 5)
    monkeypatch.setattr(common, "MOST_HEAVY", 8)
    edges = [(7, i) for i in range(8, 60)] + [(i, 500) for i in range(100, 140)] + [(1, 139), (2, 3), (900, 901), (901, 902)] + [(300 + i, 301 + i) for i in range(40)]
    rows = {tuple(r) for r in simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    want = {(i, 7) for i in range(7, 60)} | {(i, 1) for i in (1, 500, *range(100, 140))} | {(2, 2), (3, 2), (900, 900), (901, 900), (902, 900)} | {(300 + i, 300) for i in range(41)}
    assert rows == want
    texts = ["one and the same text"] * 60 + [f"own text {i} of words w{i} x{i} y{i}" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in near_copies.keep_one(docs).collect()} == {0, *range(60, 80)}
    assert {r["component_id"] for r in simhash.near_duplicates(docs).where("doc_id < 60").collect()} == {0}


def test_long_chain_and_empty_tables(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r["root"] for r in simhash.components(chain).collect()} == {0}
    assert simhash.components(chain.limit(0)).count() == 0
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "a b c"), (2, "A B C"), (3, "other words here"), (3, "other words here"), (None, "a b c"), (None, "lonely text x"), (None, "lonely text x")]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "a b c"), (0, "lonely text x"), (1, "a b c"), (3, "other words here")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["component_id"] for r in found if r["doc_id"] is None].count(None) == 2 and len(found) == 7


@pytest.mark.parametrize("block", [256, 2])
def test_near_copies_of_five_words_go(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "LEAST_BLOCK", block)
    monkeypatch.setattr(near_copies, "MOST_BLOCK", block)
    rng, texts = random.Random(8), {}

    def shingles(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    for group in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts[100 * group] = words
        for k, edits in enumerate((1, 3, 6, 8, 12, 20), 1):
            copy = list(words)
            for at in rng.sample(range(300), edits):
                copy[at] = "changed"
            texts[100 * group + k] = copy
    sets = {i: shingles(w) for i, w in texts.items()}
    component, planted = {i: i for i in texts}, []
    for i in sorted(texts):
        for j in range(i - i % 100, i):
            similarity = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if similarity >= 0.8:
                planted.append(similarity)
                old, new = sorted((component[i], component[j]), reverse=True)
                component = {k: new if c == old else c for k, c in component.items()}
    assert sum(s < 0.85 for s in planted) >= 20 and sum(s > 0.95 for s in planted) >= 20
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.keep_one(df.repartition(4)).collect()} == set(component.values())


def test_near_copies_link_across_stars(spark):
    words = [f"w{i}" for i in range(400)]  # a long chain of windows: neighbours are alike, the ends are not
    df = spark.createDataFrame([(i, " ".join(words[i * 10 : i * 10 + 200])) for i in range(20)] + [(99, None), (98, ""), (97, "a b"), (96, "A  b")], "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.keep_one(df).collect()} == {0, 96, 98}


def test_simhash_query_by_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    ids = sorted(texts)
    prints, roots = brute_components([texts[i] for i in ids])
    rows = {r["doc_id"]: r for r in queries.QUERIES["op4_simhash"](spark, f"{DATA}/sf0.001").collect()}
    assert {i: (rows[i]["fingerprint"], rows[i]["component_id"]) for i in ids} == {i: (f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, roots)}


# Sharding


def test_heap_goes_to_the_least_loaded():
    assert sharding.longest_first([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def check_shards(rows, texts, shards):
    loads, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for row, text in zip(rows, texts, strict=True):
        data = (text or "").encode()
        assert (row["size"], row["text_crc32"], row["law"], row["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        loads[row["shard"]] += row["size"]
        slots[row["shard"]].append(row["slot"])
        groups[text or ""].add(row["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(loads) <= set(range(shards))
    assert all(len(g) == 1 for g in groups.values())
    return [loads[s] for s in range(shards)]


def test_sharding_query(spark):
    rows = queries.QUERIES["op7_sharding"](spark, f"{DATA}/sf0.01").orderBy("doc_id").collect()
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    loads = check_shards(rows, texts, 24)
    assert max(loads) <= 1.02 * sum(loads) / 24


def test_sharding_query_by_brute_force(spark):
    import hashlib

    import xxhash

    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()
    sizes, of = defaultdict(int), {}
    for row in docs:
        data = (row["text"] or "").encode()
        of[row["doc_id"]] = hashlib.sha256(data).hexdigest()
        sizes[of[row["doc_id"]]] += len(data) + 8
    total, units = sum(sizes.values()), defaultdict(int)
    name = {}
    for group, size in sizes.items():
        heavy = size * 24 * sharding.HEAVY > total
        name[group] = f"group {group}" if heavy else f"parcel {xxhash.xxh64_intdigest(group.encode(), 42) % sharding.LIGHT}"
        units[name[group]] += size
    loads, place = [0] * 24, {}
    for unit in sorted(units, key=lambda u: (-units[u], u)):
        shard = loads.index(min(loads))
        place[unit] = shard
        loads[shard] += units[unit]
    rows = queries.QUERIES["op7_sharding"](spark, f"{DATA}/sf0.01").collect()
    assert {r["doc_id"]: r["shard"] for r in rows} == {i: place[name[g]] for i, g in of.items()}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding_of_awkward_rows(spark):
    texts = [None, "", "a", "a", "é", "x" * 100_000] + ["copy"] * 300 + [str(i) for i in range(300)]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    rows = sharding.report(df, 3).orderBy("doc_id").collect()
    check_shards(rows, texts, 3)
    assert sharding.report(df.limit(0)).count() == 0
    twice = sharding.report(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")).collect()
    assert len(twice) == 3 and all(r["slot"] >= 0 for r in twice)


# Mixing


def fill(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in names if target[s] > most * sizes[s] * (1 + 1e-12)} - capped
        if not over:
            return target
        capped |= over


def check_mix(rows, sources):
    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for row, source in zip(rows, sources, strict=True):
        sizes[source] += row["size"]
        taken[source] += row["taken"]
        biggest[source] = max(biggest[source], row["size"])
        assert row["taken"] in (0, row["size"], 2 * row["size"], 3 * row["size"])
    target = fill(sizes)
    for row, source in zip(rows, sources, strict=True):
        assert row["source_size"] == sizes[source] and row["target"] == pytest.approx(target[source])
    for source in sizes:
        assert abs(taken[source] - target[source]) <= biggest[source] / 2 + 1e-6, source


def test_mixing_as_sql(spark, duck):
    same_rows(spark, duck, queries.QUERIES["op8_mixing"], queries.ORACLE_SQL["op8_mixing"])


def test_mixing_of_awkward_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "w"]) if i % 7 == 0 else "w " * rng.randint(1, 40), rng.choice(["a"] * 20 + ["b", "é", None, ""])) for i in range(900)]
    df = spark.createDataFrame([(*r, "mine", "mine") for r in rows], "doc_id long, text string, source string, size string, key string")
    found = mixing.report(df).orderBy("doc_id").collect()
    check_mix(found, [r[2] for r in rows])
    assert found == mixing.report(df.repartition(5)).orderBy("doc_id").collect()
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(counts.get(r["doc_id"], 0) * r["size"] == r["taken"] for r in found)


def test_mixing_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.report(spark.createDataFrame([], schema)).count() == 0
    wordless = mixing.report(spark.createDataFrame([(1, "", "a"), (2, None, "b")], schema)).collect()
    assert [r["taken"] for r in wordless] == [0, 0] and [r["target"] for r in wordless] == [0.0, 0.0]
    alike = mixing.report(spark.createDataFrame([(None, "w w", "a")] * 4 + [(5, "w " * 30, "b")], schema)).collect()
    assert len({r["taken"] for r in alike if r["doc_id"] is None}) == 1
    alone = mixing.report(spark.createDataFrame([(1, "w w w", "a")], schema)).first()
    assert (alone["target"], alone["taken"]) == (3.0, 3)


def test_mixing_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    monkeypatch.setattr(common, "HEAVY_ROWS", 20)
    monkeypatch.setattr(common, "MOST_HEAVY", 20)
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 9), rng.choice(["s"] * 300 + [f"t{k}" for k in range(500)] + [None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    check_mix(mixing.report(df).orderBy("doc_id").collect(), [r[2] for r in rows])
    assert mixing.mix(df).count() == sum(r["taken"] // r["size"] for r in mixing.report(df).collect())


def test_chances_follow_the_weights_of_documents(spark, monkeypatch):
    rows = [(i, "w", "a", float(1 + i % 4)) for i in range(400)] + [(i, "w", "b", 1.0) for i in range(400, 500)] + [(999, "w w w", "a", None), (998, "w", "a", -1.0)]
    df = durable(spark.createDataFrame(rows, "doc_id long, text string, source string, weight double"))
    sizes = {"a": 404, "b": 100}
    target, times = fill(sizes), defaultdict(int)
    draws = 12
    for seed in range(draws):
        monkeypatch.setattr(mixing, "draw", lambda doc_id, seed=seed, plain=mixing.draw: F.expr(f"(pmod(xxhash64(doc_id, {seed}), 1000003) + 0.5) / 1000003"))
        found = mixing.report(df, F.col("weight")).collect()
        taken = defaultdict(int)
        for r in found:
            taken["a" if r["doc_id"] < 400 or r["doc_id"] > 900 else "b"] += r["taken"]
            times[r["doc_id"]] += r["taken"]
        assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert times[999] == times[998] == 0
    rate = target["a"] / sum(w for _, _, s, w in rows if s == "a" and w and w > 0)
    for k in range(4):
        mean = sum(times[i] for i in range(k, 400, 4)) / 100 / draws
        assert mean == pytest.approx(min(3, rate * (k + 1)), abs=0.06), k


def test_limits_of_copies_are_reshared(spark):
    rows = [(i, "w", "a", 1.0) for i in range(100)] + [(100, "w", "a", 1e6), (101, "w", None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    found = {r["doc_id"]: r for r in mixing.report(df, F.col("weight")).collect()}
    assert found[100]["taken"] == 3 and abs(sum(r["taken"] for i, r in found.items() if i <= 100) - found[0]["target"]) <= 1


# URL filter


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG/es/1", "https://a.example.org/en/12?x=/#y", "http://example.org/en/2", "http://com/fr/", "http://x.com/fr", "http://x.com/de/a",
    "http://notorg/x", "ftp://x.org", "http://x.net/en/1", "http://x.net/en/1", "a://b://c/d", "http://h?q/p", "http://h#f/p", "http://ÄB.com/é\nü/ z", "http://x.com/" + "long/" * 5000, "http://-",
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "mine", "mine") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    rows = url_filter.report(df).orderBy("page_id").collect()
    assert len(rows) == len(URLS)
    for row, url in zip(rows, URLS, strict=True):
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == (verdict or ("allow" if row["score"] >= 0 else "block"))
    assert url_filter.report(df.limit(0)).count() == 0
    untrained = url_filter.report(df.where("page_id in (0, 1, 12)")).collect()
    assert {(r["verdict"], r["score"]) for r in untrained} == {("allow", 0.0)}


def plain_likelihood(text, counts, order, characters):
    """Log-likelihood of a text from plain counts of (context, character)."""
    total, padded = 0.0, ["^"] * order + list(text)
    for i in range(order, len(padded)):
        p = 1 / (len(characters) + 2)
        for k in range(order + 1):
            context = tuple(padded[i - k : i])
            if counts[k]:
                seen = {g: n for g, n in counts[k].items() if g[:-1] == context}
                p = (seen.get((*context, padded[i]), 0) + url_filter.SMOOTHING * p) / (sum(seen.values()) + url_filter.SMOOTHING)
        total += np.log(p)
    return total


def test_models_by_brute_force(spark):
    training = [("allow", t) for t in ("ab.com/x", "ac.com/y", "ab.com/z")] + [("block", t) for t in ("zz.net/1", "zy.net/22")]
    model = url_models.fit(spark.createDataFrame(training, "verdict string, text string"))
    tests = ["ab.com/x", "zz.net/9", "q", ""]
    expected = []
    for text in tests:
        sides = []
        for side in ("allow", "block"):
            counts = [defaultdict(int) for _ in range(url_filter.ORDER + 1)]
            for verdict, t in training:
                padded = ["^"] * url_filter.ORDER + list(t)
                for i in range(url_filter.ORDER, len(padded)):
                    for k in range(url_filter.ORDER + 1):
                        counts[k][tuple(padded[i - k : i + 1])] += verdict == side
            counts = [{g: n for g, n in c.items() if n} for c in counts]
            sides.append(plain_likelihood(text, counts, url_filter.ORDER, url_filter.CHARACTERS))
        expected.append((sides[0] - sides[1]) / max(1, len(text)) - model.threshold)
    assert model.scores(tests) == pytest.approx(expected)
    assert model.scores(["ab.com/y"])[0] > 0 > model.scores(["zz.net/3"])[0]


def test_every_gram_counts_and_whole_urls_are_judged(spark):
    urls = [f"http://x.com/{'fr' if i % 2 else 'de'}/p{i * 7919 % 1000}?q={i}" for i in range(200)]
    urls += ["http://x.net/a?lang=fr", "http://x.net/a?lang=de", "x.com/fr/p1?q=1", "x.com/de/p2?q=2", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.report(df.repartition(3)).orderBy("page_id").collect()
    training = [(r["verdict"], urls[r["page_id"]]) for r in rows if r["rule"]]
    model = url_models.fit(spark.createDataFrame(training, "verdict string, text string"))
    assert [r["score"] for r in rows] == pytest.approx(list(model.scores([u or "" for u in urls])))
    assert len({r["score"] for r in rows[-5:]}) == 5


def test_threshold_is_of_urls_that_were_held_out(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_ROWS", 30)
    monkeypatch.setattr(common, "MOST_HEAVY", 30)
    urls = [f"http://x.com/{'fr' if i % 2 else 'de'}/p{i * 7919 % 1000}?q={i}" for i in range(300)] + ["http://x.com/fr/same"] * 90 + ["http://y.net/fr/1", "http://y.net/de/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    rows = url_filter.judge(df).collect()
    training = [("allow" if "/fr/" in u else "block", u) for u in urls if "y.net" not in u]
    frame = spark.createDataFrame(training, "verdict string, text string")
    held = {r["text"] for r in frame.where(url_filter.is_held_out(F.col("text"))).collect()}
    model = url_models.fit(frame.where(~url_filter.is_held_out(F.col("text"))))
    raw = dict(zip(sorted(held), model.scores(sorted(held)) + model.threshold, strict=True))
    scores = [(raw[u], v) for v, u in training if u in held]
    threshold = url_models.fit(frame).threshold

    def errors(cut):
        return sum(np.mean([(s >= cut) != (v == "allow") for s, v in scores if v == side]) for side in ("allow", "block"))

    step = 2 * url_filter.SPAN / url_filter.BINS
    assert errors(threshold) <= min(errors(s + d) for s, _ in scores for d in (-step, step)) + 1e-9
    assert len(rows) == len(urls) and {r["verdict"] for r in rows if "fr" in r["url"]} == {"allow"} and {r["verdict"] for r in rows if "de" in r["url"]} == {"block"}


def test_url_query(spark):
    found = queries.QUERIES["op9_url_filter"](spark, f"{DATA}/sf0.01")
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()}
    rows = found.collect()
    assert len(rows) == len(pages)
    for row in rows:
        assert (row["host"], row["path"]) == plain_parts(pages[row["page_id"]])
        assert row["rule"] == plain_rule(row["host"], row["path"])[0]
    ruled = [r for r in rows if r["rule"]]
    assert np.mean([(r["score"] >= 0) == (r["verdict"] == "allow") for r in ruled]) > 0.9


# HTML extraction

ARTICLE = "<article><h1>Title &amp; more</h1><p>First   paragraph &lt;here&gt; with\n some <b>bold</b> text that goes on for a while.<p>Second one, <a href='#'>with a link</a>, unclosed.<br>After a break.</article>"
TEXT = "Title & more\n\nFirst paragraph <here> with some bold text that goes on for a while.\n\nSecond one, with a link, unclosed. After a break."


NINE = "".join(f"<p>Paragraph {i} has some words, enough of them to be told from a menu.</p>" for i in range(9))
NINE_TEXT = "\n\n".join(f"Paragraph {i} has some words, enough of them to be told from a menu." for i in range(9))


def test_deep_and_unclosed_pages_take_linear_memory_and_time():
    import time
    import tracemalloc

    for page in ("<div>" * 200_000 + "deep", "<b>" * 60_000 + "<hr>x" * 60_000, "<div>" * 60_000 + "</span>" * 60_000 + "deep", "<div>text" * 30_000, "<p><i>" * 60_000 + "x"):
        tracemalloc.start()
        began = time.process_time()
        blocks = html_extract.content_blocks(page)
        assert tracemalloc.get_traced_memory()[1] < 150e6 and time.process_time() - began < 60
        tracemalloc.stop()
        assert blocks and len(blocks) == page.count("x") + page.count("deep") if "text" not in page else len(blocks) == 30_000


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<html><head><title>T</title></head><body><nav><ul><li><a>Home</a></li></ul></nav>{ARTICLE}<footer>&copy; x</footer></body>", TEXT),
        (f"<body><div id='top-menu'>a b c</div>{ARTICLE.replace('article', 'div')}<div class='comments'><p>Nice post, I like it a lot indeed.</p></div><div class='cookie-notice'>We use cookies</div></body>", TEXT),
        (f"<main><aside>See also this and that</aside>{ARTICLE}<form><label>Mail</label><input name=q><p>sign up</p></form><section class='reader-comments'>bad</section></main>", TEXT),
        (ARTICLE.replace("<p>Second", "<script>if (a < b) { x('</p>') }</script><style>p{}</style><div class='ad'>Buy <b>now</b></div><p>Second"), TEXT),
        (ARTICLE.replace("<p>Second", "<p class='advert'>Buy now<p>Second"), TEXT),
        (ARTICLE.replace("article", "ARTICLE").replace("<p>", "<P>") + "<![weird[ x ]]><!-- no --><? pi ?>", TEXT),
        ("<article>5 &#60; 6 &#x263a; &nbsp; &copy &am</article>", "5 < 6 ☺ © &am"),
        ("plain words only", "plain words only"),
        ("<ul><li>one<li>two</ul>", "one\n\ntwo"), ("<table><tr><td>a<td>b</table>", "a\n\nb"),
        (f"<div><h1>Head</h1><div class='has-sidebar'>{'<p>Some more long text of a body.' * 5}</div></div><div>x</div>", "\n\n".join(["Head"] + ["Some more long text of a body."] * 5)),
        (f"<body><div><section>{NINE}</section><section><p>A tenth one.</p></section></div></body>", NINE_TEXT + "\n\nA tenth one."),
        (f"<body><div id='page'><div>{NINE}</div><div><h2>Notes</h2><p>{'The tenth is long as well. ' * 9}</p></div></div></body>", NINE_TEXT + "\n\nNotes\n\n" + " ".join(["The tenth is long as well."] * 9)),
        (f"<head><title>T</title><body><article><h1>A</h1>{NINE}</article>", "A\n\n" + NINE_TEXT), (f"<head><meta x><div><p>Lead.{NINE}</div>", "Lead.\n\n" + NINE_TEXT), ("<head>plain words", "plain words"),
        (f"<article><header><h1>Head</h1></header><div class='entry-header'>Under it</div>{NINE}<footer>by me</footer></article><header><h2>Site</h2></header>", "Head\n\nUnder it\n\n" + NINE_TEXT),
        (f"<form id=aspnet><nav>menu</nav><div>{NINE}</div><label>Find</label><input><button>Go</button></form>", NINE_TEXT),
        (f"<article><h1>A</h1>{NINE}<form><p>Sign up here, please.</p></form></article>", "A\n\n" + NINE_TEXT), ("<form><p>Name</p><input></form>", ""),
        (f"<body><div class='werbung'>Jetzt kaufen</div><div class='barra'><ul><li><a>uno</a><li><a>dos</a><li><a>tres</a></ul></div><div>{NINE}</div><div id='comentarios'>{NINE}</div></body>", NINE_TEXT),
        (f"<article class='post comments-open'>{NINE}</article><article class='comment'><p>{'Nice. ' * 60}</p></article>", NINE_TEXT),
        (f"<div role='main'><div>{NINE}</div></div><div><p>{'Something else. ' * 9}</p></div>", NINE_TEXT), (f"<div style='display: none'>gone</div><div>{NINE}</div>", NINE_TEXT),
        (f"<article>{NINE}</article><article>{NINE}</article>", NINE_TEXT + "\n\n" + NINE_TEXT), ("<div>text" * 500, "\n\n".join(["text"] * 500)), ("<title>no head</title><p>x", "x"),
        (f"<table><tr><td>{NINE}<td>side</table>", NINE_TEXT + "\n\nside"),
        *[(f"<article>{NINE}<{tag}>{NINE}</{tag.split()[0]}></article>", NINE_TEXT + "\n\n" + NINE_TEXT) for tag in ("section id='related-work'", "section id='search-algorithms'", "div class='social-issues'", "div class='article-body template promotion-free'", "div class=searchSpace")],
        *[(f"<article>{NINE}<{tag}>{NINE}</{tag.split()[0]}></article>", NINE_TEXT) for tag in ("div class='CommentList'", "section class=commentsSection", "div id='opiniones-lectores'", "div class='share-buttons left'", "ul class='related-posts'", "div class='adBanner'", "section id=newsletter_signup")],
        (f"<article>{NINE}<div class='related-reading-now'><p><a href=x>One more story</a><p>and <a href=y>another one of these</a></div></article>", NINE_TEXT),
        (f"<article>{NINE}<div class='related-reading-now'>{NINE}<p><a href=x>Link</a></div></article>", NINE_TEXT + "\n\n" + NINE_TEXT + "\n\nLink"),
        ("<article><p>Press <button>OK</button> now, then tick the <label>box <input></label> below.<p><button>Share</button></p><button>Go</button></article>", "Press OK now, then tick the box below."),
        (f"<div class=page><div class=row><h1>Head</h1>{NINE}</div></div><div id=siteFooter><p>all rights</div>", "Head\n\n" + NINE_TEXT),
        (f"<table><tr><td class=navBar><a>a</a><a>b</a><td>{NINE}</table>", NINE_TEXT),
        ("<p>x <b>y", "x y"), ("<", "<"), ("", ""), (None, ""), ("<nav>only menu</nav>", ""), ("<script>x", ""),
    ],
)
def test_main_text(html, text):
    assert "\n\n".join(html_extract.content_blocks(html)) == text


def test_smoothing_and_threshold():
    assert html_extract.smooth(np.array([3.0, 3.0, 3.0])) == pytest.approx([3.0] * 3)
    assert html_extract.threshold(np.array([1.0, 1.0, 9.0, 11.0])) == pytest.approx(5.5)


def test_pages(spark):
    rows = [(1, "u", ARTICLE, "x"), (1, "u", ARTICLE, "x"), (None, None, None, "x"), (2, "v", "", "x"), (3, "w", "<p>" + "long words " * 50_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_extract.report(df).collect()
    assert [r["text"] for r in found[:4]] == [TEXT, TEXT, "", ""] and all(r["n_chars"] == len(r["text"]) for r in found)
    assert found[4]["n_chars"] == 50_000 * 11 - 1 and html_extract.report(df.limit(0)).count() == 0


def test_html_query_against_its_pages(spark):
    import html
    import re

    rows = queries.QUERIES["op10_html_extract"](spark, f"{DATA}/sf0.001").join(spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").drop("url"), "page_id").collect()
    assert len(rows) == 50
    for row in rows:
        article = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert row["text"] == "\n\n".join(b for b in blocks if b)
