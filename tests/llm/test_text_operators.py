"""Quality rules, quality ranker, license scan, byte-level BPE."""

import hashlib
import random
import re
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from barline.llm import bpe, license_scan, quality_ranker, quality_rules, queries

WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = "one two three four five. " * 5000
AWKWARD = [
    None, "", " ", "\n\n", "word", "a b c d e a b c d e", "x " * 9, "x " * 10, "one two three four five six seven eight nine ten.",
    "a\x0bb\x0cc\td\re\nf", "a b  c", "line one here.\nline one here.\n\nLine one here.", "### $$$ %%% text", "buy!! now!! or!! never!! ever!! again!! please!!",
    "home | about | news | contact | login\nA proper sentence stands here, and it is long enough to stay.", "All rights reserved.\n" + "good words in a line. " * 5,
    "1 2 3 4 5 1 2 3 4 5 1 2 3 4 6", "same same same same same same same", LONG, LONG, "é漢😀 ünï cödé wörds ären't rare, and they count as well.",
]


def frame(spark, texts, **extra):
    rows = [(i, t, *extra.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{n} string" for n in extra)]))


def figures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


# Quality rules


def test_rules_as_sql(spark, duck):
    same_rows(spark, duck, queries.QUERIES["op1_quality_rules"], queries.ORACLE_SQL["op1_quality_rules"])


def test_rule_figures_by_brute_force(spark):
    rng = random.Random(1)
    texts = AWKWARD + ["".join(rng.choice(["a ", "b ", "c\n", "d", "# ", "\t"]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    rows = {r["doc_id"]: r for r in quality_rules.report(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        n, chars, symbols, dup, repeat = figures(text)
        assert rows[i][1:6] == (n, chars, symbols, dup, repeat), text
        assert rows[i]["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert not (rows[i]["base_failed"] and rows[i]["kept"])


def test_lines_are_removed_before_documents(spark):
    texts = [
        "home | about | news | contact | login\nA proper sentence stands here, and it is long enough to stay in.",
        "home | about | news | contact | login\nhome | about | sports | contact | login\nshort one.",
        "Accept cookies to go on.\nA proper sentence stands here, and it is long enough to stay in.",
    ]
    rows = quality_rules.assess(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == [True, False, True]
    assert rows[0]["clean_text"] == rows[2]["clean_text"] == "A proper sentence stands here, and it is long enough to stay in."


def test_rules_keep_other_columns_and_take_empty_tables(spark):
    df = frame(spark, ["word " * 10 + "."], kept="mine", n_words="mine", other="x")
    assert quality_rules.assess(df).first()["other"] == "x" and quality_rules.assess(df).first()["n_words"] == 11
    assert quality_rules.assess(frame(spark, [], other="")).count() == 0
    nameless = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert quality_rules.report(nameless).count() == 2


def test_clean_keeps_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    kept = quality_rules.clean(docs)
    assert kept.columns == docs.columns and kept.where("n_chars <> length(text)").count() == 0
    good = spark.read.parquet(f"{DATA}/sf0.001/labels.parquet").where("quality = 1").join(docs, "doc_id")
    assert kept.join(good, "doc_id", "left_semi").count() >= 0.95 * good.count()


def test_rules_use_no_python(spark):
    plan = quality_rules.report(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Quality ranker


def test_held_out_accuracy(spark):
    found = queries.QUERIES["op3_quality_ranker"](spark, f"{DATA}/sf0.01")
    rows = found.where("held_out").join(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"), "doc_id").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    assert found.where("score < 0 or score > 1 or score is null or predicted <> cast(score >= 0.3 as int)").count() == 0


def test_held_out_follows_the_checksum(spark):
    import zlib

    rows = spark.range(200).select("id", quality_ranker.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_weights_come_from_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    good = x[:, 0] + 0.1 * rng.normal(size=400) > -1
    ranker = quality_ranker.fit_pairs(x, good)
    z = (x - np.array(ranker.centre)) / np.array(ranker.scale)
    score = 1 / (1 + np.exp(-(z @ np.array(ranker.weights) + ranker.shift)))
    assert np.mean(score[good][:, None] > score[~good][None, :]) > 0.98
    assert (score < quality_ranker.THRESHOLD).sum() == (~good).sum()  # the quantile of the labels


def test_scores_of_awkward_rows(spark):
    docs = frame(spark, AWKWARD, score="mine", quality="mine")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(15)] + [(0, None, 0), (None, 1, 0), (3, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality_ranker.report(docs, labels)
    rows = found.collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert rows == quality_ranker.report(docs, labels).collect()
    nothing = quality_ranker.report(docs, labels.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5} and {r["predicted"] for r in nothing} == {1}
    one_kind = quality_ranker.report(docs, labels.where("quality = 1")).collect()
    assert {r["score"] for r in one_kind} == {0.5}
    assert quality_ranker.report(docs.limit(0), labels).count() == 0


# License scan


def plain_scan(text):
    """All windows of all sizes within the bounds, with plain counts; templates in which too few bigrams of the text occur can't match."""
    def grams(text):
        words = re.findall(r"[^\W_]+", text.lower())
        return list(zip(words, words[1:]))

    own, matches = grams(text or ""), []
    for name, template in license_scan.TEMPLATES.items():
        wanted = Counter(grams(template))
        size = sum(wanted.values())
        if sum(g in wanted for g in own) < 2 * size / 3 - 1e-9:
            continue
        best = []
        for start in range(len(own)):
            left, shared = Counter(), 0
            for stop in range(start, min(len(own), start + int(1.5 * size + 1e-9))):
                left[own[stop]] += 1
                shared += left[own[stop]] <= wanted[own[stop]]
                value = 2 * shared / (stop - start + 1 + size)
                if value >= license_scan.THRESHOLD:
                    best.append((value, name, start, stop, shared))
        while best:  # windows that overlap: the highest coefficient
            top = max((m for m in best if m[2] == best[0][2]), key=lambda m: (m[0], -m[3]))
            for start in sorted({m[2] for m in best})[1:]:
                here = max((m for m in best if m[2] == start), key=lambda m: (m[0], -m[3]))
                if start > top[3]:
                    break
                top = here if here[0] > top[0] else top
            matches.append(top)
            best = [m for m in best if m[2] > top[3]]
    chosen = []
    for match in sorted(matches, key=lambda m: (-m[4], -m[0], m[1], m[2])):
        if all(match[3] < other[2] or match[2] > other[3] for other in chosen):
            chosen.append(match)
    return sorted((start, name, value, stop - start + 2) for value, name, start, stop, _ in chosen)


def test_windows_by_brute_force():
    rng, scanner = random.Random(2), license_scan.Scanner()
    names = sorted(license_scan.TEMPLATES, key=lambda n: len(license_scan.TEMPLATES[n]))[:16]
    for _ in range(150):
        text = []
        for _ in range(rng.randint(1, 3)):
            words = license_scan.TEMPLATES[rng.choice(names)].split()
            for _ in range(rng.randint(0, max(1, len(words) // 5))):
                words[rng.randrange(len(words))] = rng.choice(["other", "words", "License,"])
            text += ["so"] * rng.randint(0, 9) + words[rng.randint(0, len(words) // 5) : rng.randint(1, len(words))]
        text = " ".join(text)
        assert [(c, a, pytest.approx(b), d) for a, b, c, d in scanner.scan(text)] == plain_scan(text)


def test_every_template_is_found_wrapped_and_embedded():
    scanner, rng = license_scan.Scanner(), random.Random(5)
    for name, template in license_scan.TEMPLATES.items():
        words = template.split()
        wrapped = "".join(w + rng.choice([" ", " ", "\n", "\n * ", "\r\n# "]) for w in words)
        for text in (template, f"It begins here and {wrapped} and goes on. " * 2, f"/* {wrapped} */\n\nint x;"):
            found = scanner.scan(text)
            assert {f[0] for f in found} == {name} and found[0][1] == pytest.approx(1.0, abs=0.15)
    assert [f[0] for f in scanner.scan("see: licensed under the GNU General\nPublic License, version 3. more")] == ["GPL-3.0 line"]


def test_notices_in_documents(spark):
    mit = license_scan.TEMPLATES["MIT"]
    texts = ["Some words. Released under the MIT License. More words.", "a\n\n" + mit.replace(" to ", "\nto ", 2) + "\n\nb", "nothing here", None, "", "MIT License", "All rights reserved.", "All rights reserved.", "words " * 300_000 + mit + " more" * 100_000]
    rows = license_scan.report(frame(spark, texts, licenses="mine", best="mine")).orderBy("doc_id").collect()
    assert [r["license"] for r in rows] == ["MIT line", "MIT", None, None, None, None, "All rights reserved", "All rights reserved", "MIT"]
    assert [r["flagged"] for r in rows] == [True, True, False, False, False, False, True, True, True]
    assert rows[0]["dice"] == 1.0 and rows[3]["n_notices"] == 0
    assert license_scan.report(frame(spark, [])).count() == 0


def test_license_query_by_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    rows = queries.QUERIES["op5_license_scan"](spark, f"{DATA}/sf0.001").collect()
    assert len(rows) == len(docs) and sum(r["flagged"] for r in rows) > 0
    for row in rows:
        want = plain_scan(docs[row["doc_id"]])
        best = min(((-value, -words, name) for _, name, value, words in want), default=None)
        assert (row["license"], row["n_notices"], row["flagged"]) == (best and best[2], len(want), bool(want))
        assert row["dice"] == (pytest.approx(-best[0]) if best else None)


# Byte-level BPE


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=bpe.load_ranks(queries.RANKS), special_tokens={})


def test_segment_tree_as_the_library(reference):
    rng, encoder = random.Random(1), bpe.Encoder(queries.RANKS, queries.PATTERN)
    alphabet = ["a", "é", "漢", "\n", " ", "  ", "\t", "!", "😀", "1", "ab", "　", "'s", "𝒳", "<|endoftext|>", "th", "er"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 150)))
        ids = list(encoder(text))
        assert ids == reference.encode_ordinary(text)
        assert b"".join(bpe.tokens(queries.RANKS)[i] for i in ids).decode() == text


def test_narrow_pattern_is_the_pattern():
    import regex

    whole, quick = regex.compile(queries.PATTERN), bpe.narrow(queries.PATTERN)
    signs = [chr(i) for i in range(256)]
    for a in signs:
        for text in (a, " " + a, a + a, "a" + a, "1" + a, a + " ", "  " + a + "x", "'" + a + "l"):
            assert quick.findall(text) == whole.findall(text)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(signs[:128] + [" ", "a", "1", "'"] * 20) for _ in range(100))
        assert quick.findall(text) == whole.findall(text)
    assert bpe.narrow(r"\w+|.") is None


def test_long_matches_and_texts(reference, monkeypatch):
    encoder = bpe.Encoder(queries.RANKS, queries.PATTERN)
    for text in ("x" * 3000, "ab" * 2000, LONG, " " * 500 + "a"):
        assert list(encoder(text)) == reference.encode_ordinary(text)
    monkeypatch.setattr(bpe, "MATCHES_AT_ONCE", 10)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 3000)
    small = bpe.Encoder(queries.RANKS, queries.PATTERN)
    for text in (LONG[:2000], "".join(f" {i} word{i}" for i in range(500))):
        assert list(small(text)) == reference.encode_ordinary(text)
        assert small.known.bytes + sum(sys.getsizeof(x) + sys.getsizeof(y) + bpe.ENTRY_BYTES for x, y in small.known.older.items()) < 3000 + 2 * 10 * 250
        assert not getattr(small.known.older, "older", None)


def test_digests(spark, reference):
    docs = frame(spark, AWKWARD, ids="mine", decoded="mine")
    rows = {r["doc_id"]: r for r in bpe.digests(docs, queries.RANKS, queries.PATTERN).collect()}
    for i, text in enumerate(AWKWARD):
        ids = reference.encode_ordinary(text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert rows[i][1:] == want
    assert bpe.digests(docs.limit(0), queries.RANKS, queries.PATTERN).count() == 0


def test_ids_and_bytes_as_columns(spark, reference):
    docs = frame(spark, AWKWARD, ids="mine", decoded="mine")
    for row in bpe.encode_documents(docs, queries.RANKS, queries.PATTERN).collect():
        text = AWKWARD[row["doc_id"]] or ""
        assert row["ids"] == reference.encode_ordinary(text) and bytes(row["decoded"]) == text.encode()


def test_bpe_query_as_the_library(spark, reference):
    rows = queries.QUERIES["op6_byte_bpe"](spark, f"{DATA}/sf0.001").join(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"), "doc_id").collect()
    assert len(rows) == 200
    for row in rows:
        ids = reference.encode_ordinary(row["text"])
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(row["text"].encode()).hexdigest()
