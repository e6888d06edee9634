"""Line-first cleaning, with DataFrame functions only.

Punctuation, navigation and boilerplate rules are evaluated on each line; failing lines are removed,
and a document that loses too much of its text is rejected. Two whole-text figures reject first: too
few words, and too many words inside repeated 5-word windows.

Everything happens within a row: no shuffle, whatever the size of a document or its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import SPACES_PATTERN, let, text_of, words_of

SYMBOLS = "#*$%&|<>"
#: Marks that end a sentence or a clause; a line of LONG_LINE words or more needs one of them.
MARKS = ".!?:;,…。！？：；，、"
LONG_LINE = 12
#: Most symbols and exclamation marks, in hundredths of a line's characters.
MOST_SYMBOLS, MOST_SHOUTS = 10, 8
#: A line with this many separators and at most MENU_WORDS words for each is navigation.
SEPARATORS = r" [|>»›•·/] "
LEAST_SEPARATORS, MENU_WORDS = 3, 4
#: Fixed phrases of page furniture; a line of at most BOILERPLATE_CHARS characters with one of them is boilerplate.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "accept cookies", "privacy policy", "terms of use", "terms of service",
    "terms and conditions", "sign up for our newsletter", "subscribe to our newsletter", "enable javascript",
    "javascript is disabled", "click here", "read more", "share this", "follow us on", "skip to content",
    "back to top", "powered by", "lorem ipsum",
)
BOILERPLATE_CHARS = 160
#: A document is rejected if it loses more than this many hundredths of its word characters.
MOST_LOST = 50
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20


def _symbols(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule; cheap tests stand first, since few lines get past them."""
    n = F.char_length(line)
    words = F.size(words_of(line))
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    punctuation = (
        (_symbols(line) * 100 > n * MOST_SYMBOLS)
        | ((n - F.char_length(F.replace(line, F.lit("!"), F.lit("")))) * 100 > n * MOST_SHOUTS)
        | (~line.rlike(f"[{MARKS}]") & (words >= LONG_LINE))
    )
    navigation = (separators >= LEAST_SEPARATORS) & (words <= (separators + 1) * (MENU_WORDS + 1))
    boilerplate = (n <= BOILERPLATE_CHARS) & F.lower(line).rlike("|".join(BOILERPLATE))
    return punctuation | navigation | boilerplate


def repeated_words(words: Column) -> Column:
    """Words that lie in a WINDOW-word window found twice or more in the array, the first one included."""

    def window(i: Column) -> Column:
        return F.array_join(F.slice(words, i + 1, WINDOW), " ")

    def covered(starts: Column) -> Column:
        # Each start covers up to the next one, WINDOW words at most.
        gaps = F.transform(starts, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - at, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def in_pairs(ordered: Column, key: str) -> Column:
        """Of structs sorted by key, those that share theirs with a neighbour."""
        return F.filter(
            ordered,
            lambda x, k: F.coalesce((F.get(ordered, k - 1)[key] == x[key]), F.lit(False))
            | F.coalesce((F.get(ordered, k + 1)[key] == x[key]), F.lit(False)),
        )

    def by_text(candidates: Column) -> Column:
        named = F.transform(candidates, lambda x: F.struct(window(x["at"]).alias("window"), x["at"].alias("at")))
        return let(
            F.array_sort(named),
            lambda ordered: let(F.array_sort(F.transform(in_pairs(ordered, "window"), lambda x: x["at"])), covered),
        )

    def by_hash(hashes: Column) -> Column:
        marked = F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            let(F.array_sort(marked), lambda ordered: let(in_pairs(ordered, "hash"), by_text))
        )

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) < WINDOW, 0).otherwise(let(hashes, by_hash)).cast("long")


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_chars")


def _assessed(docs: DataFrame, text: str) -> DataFrame:
    """doc (a struct of the columns of docs), clean_text and FIGURES."""
    body = text_of("body")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        worded = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        failed = F.array_join(F.filter(worded, line_fails), "\n")
        return F.struct(
            let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.char_length(F.regexp_replace(failed, SPACES_PATTERN, "")).cast("long").alias("lost"),
        )

    found = (
        docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("doc"), F.col(f"`{text}`").alias("body"))
        .withColumn("words", let(words_of(body), of_words))
        .withColumn("lines", let(F.split(body, "\n"), of_lines))
        .select(
            "doc",
            "words.*",
            _symbols(body).cast("long").alias("n_symbols"),
            "lines.n_dup_lines",
            (F.col("words.word_chars") - F.col("lines.lost")).alias("clean_chars"),
            F.when(F.col("lines.lost") == 0, body).otherwise(F.array_join(F.filter(F.split(body, "\n"), lambda x: ~line_fails(x)), "\n")).alias("clean_text"),
        )
    )
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    lost_much = 100 * (F.col("word_chars") - F.col("clean_chars")) > MOST_LOST * F.col("word_chars")
    return found.withColumn("base_failed", base_failed).withColumn("kept", ~(base_failed | lost_much))


def assess(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with clean_text, the figures of the text, base_failed and kept.

    A null text counts as empty: no words, base_failed. Lines are cut at \\n; blank lines stay and count
    for nothing. Rows are judged by themselves, so ties and repeated rows are judged alike. Columns of docs
    with the name of a result are replaced; other columns are kept. An empty table gives no rows.
    """
    results = ("clean_text", *FIGURES)
    return _assessed(docs, text).select(*[F.col("doc")[name].alias(name) for name in docs.columns if name not in results], *results)


def report(docs: DataFrame) -> DataFrame:
    """The verdict on each document, without its text."""
    return assess(docs.select("doc_id", "text")).select("doc_id", *FIGURES)


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents, without their failing lines; a column n_chars follows the text. All other columns are kept as they are,
    whatever their names. Null and empty texts are rejected, repeated rows are each kept or not."""
    changed = {"text": F.col("clean_text"), "n_chars": F.char_length("clean_text")}
    return _assessed(docs, "text").where("kept").select(
        *[changed[f.name].cast(f.dataType).alias(f.name) if f.name in changed else F.col("doc")[f.name].alias(f.name) for f in docs.schema]
    )


_SYMBOL_CLASS = "[#*$%&|<>]"
_LINE_FAILS = f"""(
    100 * (length(l) - length(translate(l, '{SYMBOLS}', ''))) > {MOST_SYMBOLS} * length(l)
    OR 100 * (length(l) - length(replace(l, '!', ''))) > {MOST_SHOUTS} * length(l)
    OR (len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) >= {LONG_LINE} AND length(translate(l, '{MARKS}', '')) = length(l))
    OR (len(regexp_extract_all(l, '{SEPARATORS}')) >= {LEAST_SEPARATORS}
        AND len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) <= (len(regexp_extract_all(l, '{SEPARATORS}')) + 1) * {MENU_WORDS + 1})
    OR (regexp_matches(lower(l), '{"|".join(BOILERPLATE)}') AND length(l) <= {BOILERPLATE_CHARS})
)"""

ORACLE = f"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
    FROM documents
), lines AS (
    SELECT doc_id, unnest(ls) AS l FROM d
), lost AS (
    SELECT doc_id, sum(length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS chars
    FROM lines WHERE {_LINE_FAILS} GROUP BY doc_id
), starts AS (
    SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW}
), windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS n FROM starts
), repeated AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range({WINDOW}) r(k) WHERE n > 1 GROUP BY doc_id
), f AS (
    SELECT d.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '{_SYMBOL_CLASS}'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.chars, 0)::BIGINT AS lost
    FROM d LEFT JOIN repeated r ON r.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed,
    NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words OR 100 * lost > {MOST_LOST} * word_chars) AS kept,
    (word_chars - lost)::BIGINT AS clean_chars
FROM f
"""
