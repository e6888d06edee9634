"""The corpus pipeline: each stage against its own input, and the whole of it."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import DATA
from test_corpus_operators import fill
from test_text_operators import figures

import corpus_pipeline
from barline.llm import mixing, quality_ranker, quality_rules, queries


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir, out = f"{DATA}/sf0.001", []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir).cache()
        out.append((docs, made))
        docs = made
    return out


def ids(df):
    return {r["doc_id"] for r in df.collect()}


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near-dedup", "mixing", "byte-level BPE"]
    assert all(made.columns == docs.columns for docs, made in stages[:-1])


def test_rejected_documents_go(spark, stages):
    (docs, cleaned), (_, good) = stages[:2]
    assert ids(cleaned) == ids(quality_rules.report(docs).where("kept")) < ids(docs)
    raw = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    ranker = quality_ranker.learn(raw, spark.read.parquet(f"{DATA}/sf0.001/labels.parquet"))
    assert ids(good) == ids(quality_ranker.judge(cleaned, ranker).where("predicted = 1"))
    liked = spark.read.parquet(f"{DATA}/sf0.001/labels.parquet").where("quality = 1")
    assert len(ids(good) & ids(liked)) >= 0.9 * len(ids(docs) & ids(liked))


def test_one_of_each_group_stays(stages):
    docs, kept = stages[2]
    assert kept.count() == len(ids(kept)) and ids(kept) == set(plain_copies({r["doc_id"]: r["text"] for r in docs.collect()}).values())


def test_copies_follow_the_mix(stages):
    docs, mixed = stages[3]
    words = {r["doc_id"]: r["taken"] for r in mixing.report(docs).collect()}
    counts = mixed.groupBy("doc_id").count().join(mixing.report(docs), "doc_id").collect()
    assert all(r["count"] * r["size"] == words[r["doc_id"]] for r in counts)
    assert {i for i, w in words.items() if w} == {r["doc_id"] for r in counts}


def test_digests_are_of_the_mixed_texts(stages):
    docs, made = stages[4]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert made.count() == docs.count()
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in made.collect())


def test_run_is_the_stages_in_turn(spark, stages):
    whole = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    assert sorted(whole.collect()) == sorted(stages[-1][1].collect())


def test_every_operator_has_its_query():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert all(sum(name.startswith(f"op{n}_") for name in found) == 1 for n in range(1, 11)) and "pipeline" in found
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_empty_corpus(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/sf0.001/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# The stages in plain Python


def plain_shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_copies(texts):
    """The smallest doc_id that each doc_id can reach over pairs alike in 0.8 of their shingles."""
    root, sets = {i: i for i in texts}, {i: plain_shingles(t) for i, t in texts.items()}
    for a in texts:
        for b in texts:
            shared = len(sets[a] & sets[b])
            if a < b and 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def plain_fails(line):
    words = [w for w in re.split("[\x20\x09-\x0d]+", line) if w]
    separators = len(re.findall(quality_rules.SEPARATORS, line))
    return (
        100 * sum(line.count(c) for c in quality_rules.SYMBOLS) > quality_rules.MOST_SYMBOLS * len(line)
        or 100 * line.count("!") > quality_rules.MOST_SHOUTS * len(line)
        or (len(words) >= quality_rules.LONG_LINE and not any(c in line for c in quality_rules.MARKS))
        or (separators >= quality_rules.LEAST_SEPARATORS and len(words) <= (separators + 1) * (quality_rules.MENU_WORDS + 1))
        or (len(line) <= quality_rules.BOILERPLATE_CHARS and any(x in line.lower() for x in quality_rules.BOILERPLATE))
    )


def plain_clean(text):
    """The text without failing lines; None if it is rejected."""
    n_words, chars, _, _, repeated = figures(text)
    left = [line for line in (text or "").split("\n") if not plain_fails(line)]
    lost = chars - sum(len(re.sub("[\x20\x09-\x0d]+", "", line)) for line in left)
    if n_words < 10 or 100 * repeated > 20 * n_words or 100 * lost > 50 * chars:
        return None
    return "\n".join(left)


def plain_features(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines, n, chars = text.split("\n"), max(1, len(words)), max(1, len(text))
    kinds = [unicodedata.category(c) for c in text]
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, len(set(words)) / n, len(set(words)) / math.sqrt(n), sum(a == b for a, b in zip(words, words[1:])) / n,
        (len(lines) - len(set(lines))) / len(lines), len(lines) / chars,
        kinds.count("Lu") / chars, sum(k[0] == "N" for k in kinds) / chars, sum(c in "#*$%&<>@_=~^" for c in text) / chars,
        text.count("!") / chars, text.count("|") / chars, sum(c in ".?" for c in text) / chars, sum(c in ",;:" for c in text) / chars, text.count("\n") / chars,
    ]


def plain_score(ranker, text):
    raw = sum(w * (x - c) / s for w, x, c, s in zip(ranker.weights, plain_features(text), ranker.centre, ranker.scale, strict=True)) + ranker.shift
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, raw))))


def plain_mix(rows):
    """Copies by doc_id, of rows (doc_id, source, words)."""
    sizes, chosen = defaultdict(int), {}
    for _, source, words in rows:
        sizes[source] += words
    target = fill(sizes)
    for source in sizes:
        ratio = target[source] / sizes[source]
        certain, chance, order = math.floor(ratio), ratio - math.floor(ratio), []
        for i, s, words in rows:
            if s == source:
                chosen[i] = certain
                u = (int(hashlib.md5(f"{mixing.SEED}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                order.append((u / (1 - u) / (chance / (1 - chance)) if chance else math.inf, i, words))
        left, through = target[source] - certain * sizes[source], 0
        for odds, i, words in sorted(order):
            before, through = through, through + words
            if odds < math.inf and (through <= left or (before < left and through - left < left - before)):
                chosen[i] += 1
    return chosen


def test_the_ranker_in_plain_python(spark):
    docs = [r for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/sf0.001/labels.parquet").collect()}
    learnt = [r for r in docs if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    learnt.sort(key=lambda r: r["doc_id"])
    ranker = quality_ranker.fit_pairs(np.array([plain_features(r["text"]) for r in learnt]), np.array([labels[r["doc_id"]] == 1 for r in learnt]))
    found = {r["doc_id"]: r for r in queries.QUERIES["op3_quality_ranker"](spark, f"{DATA}/sf0.001").collect()}
    for row in docs:
        score = plain_score(ranker, row["text"])
        assert found[row["doc_id"]]["score"] == pytest.approx(score, abs=1e-6)
        assert found[row["doc_id"]]["predicted"] == int(found[row["doc_id"]]["score"] >= 0.3)


def test_the_pipeline_in_plain_python(spark):
    import tiktoken

    from barline.llm import bpe

    ranker = quality_ranker.learn(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"), spark.read.parquet(f"{DATA}/sf0.001/labels.parquet"))
    rows = {r["doc_id"]: (r["source"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    rows = {i: (s, cleaned) for i, (s, t) in rows.items() if (cleaned := plain_clean(t)) is not None}
    rows = {i: (s, t) for i, (s, t) in rows.items() if plain_score(ranker, t) >= quality_ranker.THRESHOLD}
    stay = set(plain_copies({i: t for i, (_, t) in rows.items()}).values())
    rows = {i: x for i, x in rows.items() if i in stay}
    copies = plain_mix([(i, s, len([w for w in re.split("[\x20\x09-\x0d]+", t) if w])) for i, (s, t) in rows.items()])
    encoding, want = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=bpe.load_ranks(queries.RANKS), special_tokens={}), []
    for i, (_, text) in rows.items():
        tokens = encoding.encode_ordinary(text)
        want += [(i, len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] * copies[i]
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, f"{DATA}/sf0.001").collect()) == sorted(want)


def test_awkward_documents(spark, tmp_path):
    words = "The {} thing of this text is long enough, and it stays as it is in all stages of the run."
    long = " ".join(f"a{i} b{i * 7 % 1009} c{i * i % 2003}, d{i % 97}." for i in range(60_000))
    rows = [(1, None, "s"), (2, "", "s"), (3, " \n", None), (None, words.format("first"), "s"), (None, words.format("first"), "s"), (4, words.format("second"), "s"), (4, words.format("second"), "s"), (4, words.format("other " * 3), "t"), (5, long, "t"), (6, long, "t"), (7, words.format("second"), None)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == docs.columns
    left = sorted((r["doc_id"] or 0, len(r["text"])) for r in kept.collect())
    # Of document 4 both texts stay: they have 14 of 20 shingles in common, too few for near copies.
    assert [i for i, _ in left] == [0, 4, 4, 5] and left[3][1] == len(long) and len({n for i, n in left if i == 4}) == 2
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in found} <= {None, 4, 5} and len(found) > 0
    assert {r["decoded_sha256"] for r in found if r["doc_id"] == 5} <= {hashlib.sha256(long.encode()).hexdigest()}
