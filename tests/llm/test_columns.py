"""Extra columns of any name: every operator gives what it gives without them, and those that carry rows carry them untouched."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barline.llm import bpe, collocations, hard_negatives, html_extract, license_scan, mixing, near_copies, parity_join, quality_ranker, quality_rules, queries, sharding, simhash, topk, url_filter

#: Names that the operators use inside or give to results.
NAMES = (
    "doc", "body", "words", "lines", "clean_text", "n_words", "word_chars", "n_dup_lines", "kept", "base_failed", "clean_chars", "_words", "_lines", "score", "predicted", "held_out", "x", "wanted",
    "fingerprint", "component_id", "node", "root", "band", "bands", "sketch", "shingles", "own", "other", "low", "high", "side", "a", "b", "m", "n", "least_id", "key", "rank", "size", "u", "weight",
    "certain", "chance", "copies", "copy", "bucket", "left", "target", "source_size", "taken", "cut", "rate", "place", "part", "digest", "n_tokens", "licenses", "best", "group", "shard", "slot",
    "parcel", "within", "first", "page", "rule", "verdict", "host", "path", "times", "gram", "salt", "vector", "asks", "turn", "dims", "ids", "decoded", "rows", "stays", "a.b", "with a blank", "order", "row", "task", "w1", "f", "phrase", "sides", "chunk", "visits",
)
GOOD = "The {0} of {1} words stands here, and it goes on with {2}, so that it has a length of more than ten words."
TEXTS = [None, "", "short", *[GOOD.format(f"w{i}", f"x{i * 7 % 11}", f"y{i}") for i in range(14)], GOOD.format("w1", "x7", "y1"), "buy!! now!! or!! never!! ever!! again!! please!! x y z", "Released under the MIT License. " + GOOD.format(1, 2, 3)]


def with_extras(df, but=()):
    return df.select("*", *[F.lit(f"mine {name}").alias(name) for name in NAMES if name not in but])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(3 <= i < 18), 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int").cache()


def rows_of(df, columns=None):
    return sorted(map(str, df.select(*(columns or df.columns)).collect()))


@pytest.mark.parametrize("name", ["clean", "keep_good", "keep_one", "mix"])
def test_stages_carry_columns(docs, labels, name):
    ranker = quality_ranker.learn(docs, labels)
    stage = {"clean": quality_rules.clean, "keep_good": lambda d: quality_ranker.keep_good(d, ranker), "keep_one": near_copies.keep_one, "mix": mixing.mix}[name]
    more = with_extras(docs)
    found = stage(more)
    assert found.columns == more.columns and found.dtypes == more.dtypes
    assert rows_of(found, docs.columns) == rows_of(stage(docs))
    assert all(row[n] == f"mine {n}" for row in found.collect() for n in NAMES)
    assert found.count() > 0


def test_queries_of_documents_take_no_notice(docs, labels):
    more = with_extras(docs)
    for report in (
        quality_rules.report, lambda d: quality_ranker.report(d, with_extras(labels)), simhash.near_duplicates, license_scan.report,
        lambda d: bpe.digests(d, queries.RANKS, queries.PATTERN), sharding.report, mixing.report, parity_join.report, collocations.report,
    ):
        assert rows_of(report(more)) == rows_of(report(docs))


def test_functions_that_add_columns_keep_the_others(docs):
    for add, made in (
        (quality_rules.assess, {"clean_text", *quality_rules.FIGURES}), (license_scan.scan, {"licenses"}),
        (lambda d: bpe.encode_documents(d, queries.RANKS, queries.PATTERN), {"ids", "decoded"}), (simhash.fingerprints, {"fingerprint"}),
    ):
        found = add(with_extras(docs, made))
        assert set(found.columns) == {*docs.columns, *NAMES, *made}
        assert all(row[n] == f"mine {n}" for row in found.collect() for n in NAMES if n not in made)


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(i, f"http://x.{'com' if i % 2 else 'net'}/{'fr' if i % 4 == 1 else 'de'}/p{i}?q", f"<p>Text {i} of a page.") for i in range(20)], "page_id long, url string, html string")
    made = ("host", "path", "rule", "verdict", "score")
    found = url_filter.judge(with_extras(pages, made))
    assert all(row[n] == f"mine {n}" for row in found.collect() for n in NAMES if n not in made)
    assert rows_of(found, [*pages.columns, *made]) == rows_of(url_filter.judge(pages))
    assert rows_of(html_extract.report(with_extras(pages))) == rows_of(html_extract.report(pages))
    vectors = spark.createDataFrame([(i * 10, [float(i % 7), 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    assert rows_of(topk.report(with_extras(vectors))) == rows_of(topk.report(vectors))
    vectors = vectors.withColumn("label", (F.col("vec_id") % 3).cast("int"))
    assert rows_of(hard_negatives.report(with_extras(vectors))) == rows_of(hard_negatives.report(vectors))


def test_the_pipeline_runs_over_any_columns(spark, docs, labels, tmp_path):
    for name, extra in (("plain", False), ("more", True)):
        (with_extras(docs) if extra else docs).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path / "more"))
    assert rows_of(found) == rows_of(corpus_pipeline.run(spark, str(tmp_path / "plain"))) and found.count() > 0
