"""The n-gram join, the phrases and the hard negatives against plain Python."""

import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from conftest import same_rows

from barline.llm import collocations, hard_negatives, near_copies, parity_join, queries

WORDS = [f"w{i}" for i in range(400)]


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return frozenset([tuple(words)]) if 0 < len(words) < 3 else frozenset(zip(words, words[1:], words[2:], strict=False))


def components_of(rows, similar=90):
    """(doc_id, n, smallest doc_id reachable) by comparing all pairs; rows without a doc_id link others."""
    sets = [shingles(text) for _, text in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= similar * len(a | sets[j]) and label[i] != label[j]:
                old = label[j]
                label = [label[i] if x == old else x for x in label]
    named = defaultdict(list)
    for (doc_id, _), x in zip(rows, label, strict=True):
        if doc_id is not None:
            named[x].append(doc_id)
    return sorted(((doc_id, len(s), min(named[x], default=None)) for (doc_id, _), s, x in zip(rows, sets, label, strict=True)), key=str)


def near(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def corpus():
    rng, rows = random.Random(1), []
    for size in (3, 4, 9, 12, 14, 22, 40, 60, 150, 400, 900):
        for _ in range(4):
            base = [rng.choice(WORDS) for _ in range(size)]
            rows += [(len(rows) + k, near(rng, base, rng.randint(0, max(1, size // 40)))) for k in range(6)]
            rows.append((len(rows), " ".join(base[: max(1, size * 19 // 20)])))
    chain = [rng.choice(WORDS) for _ in range(200)]
    for _ in range(12):  # each near the one before it, the ends far apart
        rows.append((len(rows), " ".join(chain)))
        chain[rng.randrange(200)] = rng.choice(WORDS)
        chain[rng.randrange(200)] = rng.choice(WORDS)
    rows += [(5000, None), (5001, ""), (5002, " \t\r\n "), (5003, "One two"), (5004, "oNE\ttwo"), (5005, "one"), (5006, rows[3][1].upper()), (7, rows[9][1]), (7, rows[9][1]), (None, rows[20][1]), (None, "only here of all the rows")]
    rng.shuffle(rows)
    return rows


def joined(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted((tuple(r) for r in parity_join.report(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_the_join_finds_the_links_of_all_pairs(spark, monkeypatch, small):
    rows = corpus()
    if small:  # chunks with visitors, salted hubs, frequent keys and short sketches, all at once
        for name, value in (("CHUNK", 3), ("HUB", 2), ("SAMPLE", 1), ("FEW", 0), ("SKETCH_WORDS", 1), ("PAIRS", 2)):
            monkeypatch.setattr(parity_join, name, value)
        monkeypatch.setattr(parity_join, "sketch_of", lambda hashes: parity_join.parities(hashes, 1 if len(hashes) < 100 else 2))
    assert joined(spark, rows) == components_of(rows)


def test_a_failed_link_hides_no_other(spark, monkeypatch):
    """Sketches of one word let nearly everything through: the first forest is full of edges that fail."""
    rng = random.Random(8)
    monkeypatch.setattr(parity_join, "sketch_of", lambda hashes: np.zeros(1, np.uint64))
    base = [rng.choice(WORDS) for _ in range(120)]
    rows = [(i, near(rng, base, 4)) for i in range(40)]
    assert joined(spark, rows) == components_of(rows)


def test_parity_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for size in (5, 30, 300, 3000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.r_[a[size // 10 :], rng.integers(0, 1 << 63, size // 9, dtype=np.uint64)])
        own = len(np.setxor1d(a, b))
        for words in (1, 4, 64):
            x, y = (parity_join.parities(s, words) for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= own
            assert (parity_join.folded(parity_join.parities(a, 2 * words), words) == x).all()
    for size in range(1, 3000):  # two linked sets share a band, and are no farther apart than its parts allow
        for other in {size, size * 100 // 90}:
            if 100 * size >= 90 * other and parity_join.apart(size, other):
                shared = set(parity_join.bands_of(size)) & {parity_join.bands_of(other)[0]}
                assert shared and max(parts for _, parts in shared) > parity_join.apart(size, other), (size, other)


def test_join_of_an_empty_table(spark):
    assert parity_join.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("turned", [False, True])
def test_no_text_is_lost_where_rows_share_a_doc_id(spark, turned):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, b), (5, b), (5, a), (None, a), (None, "quite another text of some more words"), (None, "quite another text of some more words")]
    kept = near_copies.keep_one(spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, b), (5, a), rows[-1]], key=str)


def test_fingerprints_in_reach_are_candidates(spark, monkeypatch):
    plain = near_copies.bands_and_sketch
    monkeypatch.setattr(near_copies, "bands_and_sketch", lambda hashes: (np.arange(near_copies.BANDS, dtype=np.uint64) + np.uint64(near_copies.node_of(hashes) >> 1), plain(hashes)[1]))
    words, texts = [f"w{i}" for i in range(3000)], []
    for group in range(20):  # the first text of a group, one with another end, one of which half is another; no two sets share a band
        own = [f"{w}g{group}" for w in words]
        texts += [own, own[3:-3] + ["x", "y", "z"], own[:1500] + [f"n{w}" for w in own[1500:]]]
    sets = [near_copies.shingle_hashes(" ".join(t)) for t in texts]
    prints = np.array([near_copies.fingerprint(s) for s in sets], np.uint64)
    reached = {3 * g + 1 for g in range(20) if int(prints[3 * g] ^ prints[3 * g + 1]).bit_count() <= near_copies.RADIUS}
    assert len(reached) >= 15
    keys = [set(map(int, near_copies.bands_and_sketch(s)[0])) for s in sets]
    assert not any(keys[i] & keys[j] for i in range(len(keys)) for j in range(i))
    kept = near_copies.keep_one(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == set(range(60)) - reached


def test_one_doc_id_of_many_texts_is_linear(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    plain = near_copies.shingle_hashes

    def counted(text, *more):
        calls.add(1)
        return plain(text, *more)

    monkeypatch.setattr(near_copies, "shingle_hashes", counted)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(60)]
    kept = near_copies.keep_one(spark.createDataFrame([(1, t) for t in texts + texts[:9]], "doc_id long, text string"))
    assert sorted(r["text"] for r in kept.collect()) == sorted(texts)
    assert calls.value <= 6 * 69


def test_pairs_are_counted_by_small_buckets():
    rng = random.Random(5)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 40, "text": [" ".join(f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(5000)) for _ in range(40)]})
    every = np.full(1, -1, np.int64).view(np.uint64)
    packed = list(collocations._pair_counts(SimpleNamespace(value=every))(iter([batch])))
    words, counts = next(collocations._in_portions(iter([batch]))), Counter()
    ids, hashes = words.ids(), words.hashes()
    for a, b in zip(ids, ids[1:]):
        if a >= 0 and b >= 0:
            counts[int(collocations._pairs(hashes[[a]], hashes[[b]])[0])] += 1
    table = pa.Table.from_batches(packed).combine_chunks()
    assert sum(len(x) for name in ("low", "f") for x in table.column(name).to_pylist()) == 6 * len(counts)  # bytes; a hash and a count of their own took 12
    twice = pa.concat_tables([table, table]).sort_by("bucket")
    sums = pa.Table.from_batches(collocations._pair_sums(iter(twice.to_batches(max_chunksize=7)))).to_pydict()
    assert dict(zip(sums["h"], sums["f"], strict=True)) == {h: 2 * f for h, f in counts.items() if 2 * f >= collocations.LEAST} and len(sums["h"]) > 50


def phrases_of(rows):
    """The report by plain counting."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= 30}
        scored = []
        for p, a in candidates.items():
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            covered = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items())
            if not covered:
                scored.append((-score, -a, b" ".join(p), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(scored)[:2000])]
    return sorted(out)


def texts_with_phrases():
    rng, rows = random.Random(6), []
    common = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta\x01", "a\x00b", "x"]
    for _ in range(1500):
        words = [rng.choice(common) if rng.random() < 0.7 else f"rare{rng.randrange(3000)}" for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice([["New", "york", "city", "hall"], ["as", "well", "as"], ["x", "x", "x", "x", "x"]])
        text = " ".join(w + rng.choice(["", "", "", "", ",", ".", "!", ";\t", "\n", ":\r"]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return [*rows, ("en", None), ("en", ""), ("fr", "never often enough"), ("fr", " ,.; \n"), *[("es", "uno dos tres cuatro cinco")] * 31]


@pytest.mark.parametrize("small", [False, True])
def test_phrases_as_plain_counting(spark, monkeypatch, small):
    rows = texts_with_phrases()
    if small:  # a task's texts and rows in many portions; every word and pair is cut further
        for name, value in (("WORDS_AT_ONCE", 50), ("ROWS_AT_ONCE", 7), ("VERY_FREQUENT", 0.0), ("BITMAP_BITS", 1 << 10)):
            monkeypatch.setattr(collocations, name, value)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
        found = collocations.report(df).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, found)) == phrases_of(rows)
    assert len(found) > 20


def test_phrases_of_nothing(spark):
    assert collocations.report(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.report(spark.createDataFrame([("en", None), (None, "a b c")], "lang string, text string")).collect() == []


def negatives_of(rows):
    usable = []
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or not vector or any(x is None or not np.isfinite(x) for x in vector):
            continue
        usable.append((vec_id, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in vector)))
    out = []
    for anchor, label, q in sorted({min(r for r in usable if r[0] == i) for i in {r[0] for r in usable} if i % 100 == 0}):
        others = [(-sum(x * y for x, y in zip(q, v, strict=True)), i, kind) for i, kind, v in usable if i != anchor and len(v) == len(q)]
        for score, positive, _ in sorted(x for x in others if x[2] == label)[:5]:
            fit = sorted(x for x in others if x[2] != label and 30 * -score <= 100 * -x[0] <= 90 * -score)[:10]
            out += [(anchor, positive, rank + 1, i, -score, -s) for rank, (s, i, _) in enumerate(fit)]
    return sorted(out)


def vectors():
    rng = random.Random(9)
    rows = [(i, rng.randrange(3), [rng.gauss(0, 1) for _ in range(6)]) for i in range(700)]
    rows += [(i, rng.randrange(3), [float(rng.randint(0, 1)) for _ in range(6)]) for i in range(700, 1000)]  # many ties
    rows += [(1100, None, [1.0] * 6), (1200, 1, None), (1300, 1, [1.0, None] * 3), (1400, 1, [float("nan")] * 6), (1500, 1, [float("inf")] * 6), (1600, 2, []), (1700, 1, [0.0] * 6), (None, 1, [1.0] * 6), (1800, 2, [1.0, 2.0]), (1801, 2, [1.0, 2.0]), (1802, 1, [0.5, 1.0])]
    return rows


@pytest.mark.parametrize(("group", "leaf"), [(1 << 22, 128), (600, 4)])
def test_negatives_as_brute_force(spark, monkeypatch, group, leaf):
    monkeypatch.setattr(hard_negatives, "GROUP_VALUES", group)
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    df = spark.createDataFrame(vectors(), "vec_id long, label int, embedding array<float>").repartition(3)
    found = hard_negatives.mine(df, df["vec_id"] % 100 == 0).collect()
    assert sorted(map(tuple, found)) == negatives_of(vectors()) and len(found) > 200
    assert hard_negatives.report(df.limit(0)).collect() == []


def test_branches_outside_the_annulus_are_not_entered():
    rng = np.random.default_rng(5)
    values = hard_negatives.whole(np.concatenate([rng.normal(c, 0.05, (500, 2)) for c in (0.0, 4.0, 8.0, 12.0)]))
    tree = hard_negatives.Tree(np.arange(2000), np.zeros(2000, np.int64), values)
    query = values[1999]
    most, fewest = tree.bounds(query[None])
    asked = hard_negatives.Asked(tree, query, most[:, 0], fewest[:, 0], np.ones(2000, bool))
    best = int(query @ query)
    got = asked.nearest(*hard_negatives.window(best), 10)
    scores = (values @ query).astype(np.int64)
    fit = sorted((-int(s), int(i)) for s, i in zip((tree.values @ query).astype(np.int64), tree.ids, strict=True) if 30 * best <= 100 * s <= 90 * best)[:10]
    assert got == [(-s, i) for s, i in fit] and len(scores) == 2000
    assert len(asked.leaves) <= len(tree.leaves) / 2


def test_huge_components_are_exact():
    values = np.array([[1e300, 1.0], [2.0**40, 3.0], [1.5, -2.5]])
    exact = hard_negatives.whole(values)
    assert exact.dtype == object and exact[1, 0] == 2**48 and exact[2].tolist() == [384, -640]
    tree = hard_negatives.Tree(np.arange(3), np.zeros(3, np.int64), exact)
    most, fewest = tree.bounds(exact[1:2])
    got = hard_negatives.Asked(tree, exact[1], most[:, 0], fewest[:, 0], tree.ids != 0).nearest(None, None, 5)
    assert got == [(2**96 + 768 * 768, 1), (2**48 * 384 - 768 * 640, 2)]


@pytest.mark.parametrize("name", ["op12_collocations", "op13_hard_negatives"])
def test_queries_as_sql(spark, duck, name):
    assert same_rows(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name]) is not None


def test_estimates_do_not_grow_with_the_rounds_of_components(spark, monkeypatch):
    from barline.llm import common, simhash

    monkeypatch.setattr(common, "HEAVY_ROWS", 100)  # the way of large tables
    # A path whose nodes are numbered at random takes several rounds; one of them is a hub.
    nodes = np.random.default_rng(3).permutation(300).tolist()
    edges = [*zip(nodes, nodes[1:], strict=False), *((1000 + i, 0) for i in range(200))]
    bits, size = [], simhash._size_unless_stars

    def measured(now):
        bits.append(now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return size(now)

    monkeypatch.setattr(simhash, "_size_unless_stars", measured)
    roots = simhash.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["root"] for r in roots.collect()} == {0} and roots.count() == 500
    # Before, the estimate of the size had four times as many bits after each round (63, 257, 1030, 4121), until the driver had no memory for it.
    assert len(bits) > 3 and max(bits) < 70
