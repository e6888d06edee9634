"""Phrase collocations by contiguous pattern growth (PrefixSpan over runs of words).

Occurrences, not texts, are what is projected: of each occurrence of a frequent two-word prefix, the words that follow it, as far as
each two neighbours are frequent. Equal ones are counted together before they are dealt. A task has whole prefixes: those that start
with a word; of a very frequent word, those that start with a pair; of a very frequent pair, with three words. Its occurrences are
sorted, so a prefix's are a span of rows, which is grown to the right depth-first: the span is cut by the next word, and only frequent
cuts are grown further. Spans are grown some rows at a time; one that the end of these cuts gives a count on each side, and these are
added up. So no task holds a frequent prefix whole, and none is a limit.

What is shuffled is kept small: pairs are counted by the numbers of their buckets, a row a bucket of some texts, and an occurrence's
words are one string, ended by a space so that the rows of a prefix stay side by side when sorted.

Two bitmaps of fixed size (frequent words, frequent pairs) spare rows before the shuffles. A bitmap lets through all that is frequent
and, by chance, some that isn't, so it changes no count; in a corpus with far more frequent words than bits it spares less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.llm.common import durable

LEAST, LONGEST, BEST, COVERED = 30, 4, 2000, 80
#: The score of a phrase whose parts never occur without each other, twice over.
SCALE = 2_000_000
UNKNOWN = "und"
#: Bits of a bitmap (a power of two), words whose occurrences are counted together in a task, and rows whose spans are grown together.
BITMAP_BITS, WORDS_AT_ONCE, ROWS_AT_ONCE = 1 << 24, 1 << 20, 1 << 18
#: Pairs are counted by so many bits of a hash. A word or pair with more than this share of all words is very frequent.
PAIR_BITS, VERY_FREQUENT = 31, 1 / 500
#: Low bits of such a hash that tell the pairs of a bucket apart; as many as a uint16 has.
BUCKET_BITS = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: What ends a piece becomes a byte that UTF-8 doesn't have, a tab becomes a space.
_END = b"\xff"
_MARKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", _END * 10 + b" ")


class Known(dict):
    """Numbers of the words of a language, in a list that languages share; ends of pieces are -1."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]):
        super().__init__({_END: -1})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.words)
        self.words.append((self.lang, word))
        return at


class Words:
    """Some texts as numbers: `ids` of the words in order, -1 between pieces, and `words` and hashes by id. A word of two languages has two ids."""

    def __init__(self) -> None:
        self.langs: dict[str, Known] = {}
        self.words: list[tuple[str, bytes]] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str | None, text: str | None) -> None:
        if not text:
            return
        lang = UNKNOWN if lang is None else lang
        if lang not in self.langs:
            self.langs[lang] = Known(lang, self.words)
        found = text.encode("utf-8").lower().translate(_MARKS).replace(_END, b" " + _END + b" ").split()
        found.append(_END)
        self.parts.append(np.fromiter(map(self.langs[lang].__getitem__, found), np.int64, len(found)))
        self.size += len(found)

    def ids(self) -> np.ndarray:
        """With an end of a piece after the last word, and enough of these for LONGEST shifts."""
        return np.concatenate([*self.parts, np.full(LONGEST, -1)])

    def hashes(self) -> np.ndarray:
        import xxhash

        digest, seeds = xxhash.xxh64_intdigest, {lang: xxhash.xxh32_intdigest(lang.encode("utf-8")) for lang in self.langs}
        return np.array([digest(word, seeds[lang]) for lang, word in self.words], np.uint64)

    def columns(self) -> tuple[pa.Array, pa.Array]:
        """Languages and words by id."""
        return pa.array([lang for lang, _ in self.words], pa.string()), pa.array([word for _, word in self.words], pa.binary()).cast(pa.string())


def _in_portions(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The texts (lang, text) of a task, some WORDS_AT_ONCE words at a time."""
    now = Words()
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            now.add(lang.as_py(), text.as_py())
            if now.size >= WORDS_AT_ONCE:
                yield now
                now = Words()
    if now.size:
        yield now


def _counted(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns, and how often each is there."""
    order = np.lexsort(columns[::-1])
    columns = [column[order] for column in columns]
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for column in columns:
        fresh[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(fresh)
    return [column[starts] for column in columns], np.diff(np.append(starts, len(order)))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words in _in_portions(batches):
        ids = words.ids()
        yield pa.RecordBatch.from_arrays([*words.columns(), pa.array(np.bincount(ids[ids >= 0], minlength=len(words.words)))], names=["lang", "phrase", "f"])


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words by those of the words, PAIR_BITS long."""
    mixed = (left * _ODD ^ (left >> np.uint64(31)) ^ right) * _ODD
    return (mixed ^ (mixed >> np.uint64(29))) & np.uint64((1 << PAIR_BITS) - 1)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """BITMAP_BITS bits, as words of 64, of which those of the hashes (one column, h, of whole numbers) are set."""
    words = hashes.select(F.shiftrightunsigned("h", 6).bitwiseAND(BITMAP_BITS // 64 - 1).cast("int").alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    rows = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()  # BITMAP_BITS / 64 rows at most
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = ((hashes >> np.uint64(6)) & np.uint64(len(bits) - 1)).astype(np.int64)
    return (bits[at] >> (hashes & np.uint64(63)) & np.uint64(1)).astype(bool)


def _frequent_words(words: Words, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids, with -1 for words that aren't in the bitmap; and the hashes of all words."""
    hashes, ids = words.hashes(), words.ids()
    ids[ids >= 0] = np.where(_holds(bits, hashes)[ids[ids >= 0]], ids[ids >= 0], -1)
    return ids, hashes


def _hash_column(words: DataFrame) -> DataFrame:
    """The hashes of words (lang, phrase), as Words has them."""

    @F.arrow_udf("long")
    def hashed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import xxhash

        for langs, phrases in batches:
            pairs = zip(langs.to_pylist(), phrases.to_pylist(), strict=True)
            yield pa.array(np.array([xxhash.xxh64_intdigest(word.encode("utf-8"), xxhash.xxh32_intdigest(lang.encode("utf-8"))) for lang, word in pairs], np.uint64).view(np.int64))

    return words.select(hashed("lang", "phrase").alias("h"), "f")


def _pair_counts(bits: np.ndarray) -> Callable:
    """Rows (bucket, low, f), one for each bucket of a portion: its pairs' low bits (sorted, uint16) and how often each is there (int32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _in_portions(batches):
            ids, hashes = _frequent_words(words, bits.value)
            at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            (found,), counts = _counted(_pairs(hashes[ids[at]], hashes[ids[at + 1]]))
            bucket = (found >> np.uint64(BUCKET_BITS)).astype(np.int32)
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
            ends = np.append(starts, len(bucket))
            packed = []
            for values in (found.astype(np.uint16), counts.astype(np.int32)):  # astype keeps the low bits
                packed.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), *packed], names=["bucket", "low", "f"])

    return run


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _pair_counts, sorted by bucket, to (h, f) of the pairs with f >= LEAST. At most a batch and a bucket's sums are held."""
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        much = sums >= LEAST
        return pa.RecordBatch.from_arrays([pa.array(keys[much].astype(np.int32)), pa.array(sums[much])], names=["h", "f"])

    for batch in batches:
        if not batch.num_rows:
            continue
        low, f = (np.frombuffer(b"".join(batch.column(k).to_pylist()), kind).astype(np.int64) for k, kind in ((1, np.uint16), (2, np.int32)))
        bucket = np.repeat(batch.column(0).to_numpy().astype(np.int64), pc.binary_length(batch.column(1)).to_numpy() // 2)
        keys, sums = np.append(keys, bucket << BUCKET_BITS | low), np.append(sums, f)
        order = np.argsort(keys, kind="stable")
        keys, sums = keys[order], sums[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, sums = keys[starts], np.add.reduceat(sums, starts)
        done = np.searchsorted(keys, keys[-1] >> BUCKET_BITS << BUCKET_BITS)  # the last bucket may go on
        yield out(keys[:done], sums[:done])
        keys, sums = keys[done:], sums[done:]
    yield out(keys, sums)


def _occurrences(word_bits: np.ndarray, pair_bits: np.ndarray, words_cut: np.ndarray, pairs_cut: np.ndarray) -> Callable:
    """Rows (lang, words, n, cut): of each occurrence of a pair that passes, the words from there on as long as pairs pass, a space after each. cut: 1 where the first word is in words_cut (sorted hashes), 2 where the first pair is in pairs_cut too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _in_portions(batches):
            ids, hashes = _frequent_words(words, word_bits.value)
            pairs = np.zeros(len(ids), np.uint64)
            at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            pairs[at] = _pairs(hashes[ids[at]], hashes[ids[at + 1]])
            follows = np.zeros(len(ids), bool)  # whether the pair that starts here passes
            follows[at] = _holds(pair_bits.value, pairs[at])
            at = np.flatnonzero(follows)
            third = follows[at + 1]
            fourth = third & follows[at + 2]
            columns, counts = _counted(ids[at], ids[at + 1], np.where(third, ids[at + 2], -1), np.where(fourth, ids[at + 3], -1))
            first = hashes[columns[0]]
            cut = np.isin(first, words_cut).astype(np.int8)
            cut += cut * np.isin(_pairs(first, hashes[columns[1]]), pairs_cut)
            langs, names = words.columns()
            for start in range(0, len(counts), ROWS_AT_ONCE):
                some = [column[start : start + ROWS_AT_ONCE] for column in columns]
                joined = pc.binary_join_element_wise(*(names.take(pa.array(column, mask=column < 0)) for column in some), "", " ", null_handling="skip")
                through = slice(start, start + ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(some[0])), joined, pa.array(counts[through]), pa.array(cut[through])], names=["lang", "words", "n", "cut"])

    return run


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted occurrences to phrases (lang, phrase, f) of two words and more: counts of LEAST or more, and all counts that are a part of one:
    of spans at a border, and of pairs that several tasks have."""

    def grown(rows: pa.Table) -> pa.RecordBatch:
        lang, words = (rows.column(k).combine_chunks() for k in (0, 1))
        lang, lists = lang.dictionary_encode(), pc.split_pattern(words, " ")  # after the last space an empty string
        flat, offsets = lists.values.dictionary_encode(), lists.offsets.to_numpy()
        indices, starts, lengths = flat.indices.to_numpy(), offsets[:-1], np.diff(offsets) - 1
        # The language, then the words; -1 where there are no more.
        codes = [lang.indices.to_numpy(), *(np.where(k < lengths, indices[starts + np.minimum(k, lengths)], -1) for k in range(LONGEST))]
        names = [lang.dictionary.to_pylist(), *[flat.dictionary.to_pylist()] * LONGEST]
        through = np.concatenate([[0], np.cumsum(rows.column(2).to_numpy())])
        parts, n, out = rows.column(3).to_numpy(), len(rows), ([], [], [])

        def extend(low: int, high: int, depth: int, prefix: list[str]) -> None:
            """Rows low to high share a language and `depth` - 1 words; codes[depth] has the next one."""
            code = codes[depth][low:high]
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) + low
            ends = np.append(starts[1:], high)
            f = through[ends] - through[starts]
            part = (starts == 0) | (ends == n) | (depth == 0)
            if 0 < depth <= 2:
                part |= parts[starts] >= depth
            for i in np.flatnonzero((code[starts - low] >= 0) & (part | (f >= LEAST))):
                phrase = [*prefix, names[depth][code[starts[i] - low]]]
                if depth > 1:
                    for column, value in zip(out, (phrase[0], " ".join(phrase[1:]), int(f[i])), strict=True):
                        column.append(value)
                if depth < LONGEST:
                    extend(int(starts[i]), int(ends[i]), depth + 1, phrase)

        extend(0, n, 0, [])
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["lang", "phrase", "f"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= ROWS_AT_ONCE:
            yield grown(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield grown(pa.Table.from_batches(held))


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, n): all words of each language; and (lang, phrase, f): the phrases of 1 to LONGEST words with f >= LEAST. Both are durable."""
    texts = docs.select("lang", "text")
    counts = durable(texts.mapInArrow(_word_counts, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")))
    totals = durable(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    words = counts.where(F.col("f") >= LEAST)
    hashed = durable(_hash_column(words))
    context = docs.sparkSession.sparkContext
    word_bits = context.broadcast(bitmap(hashed))
    buckets = texts.mapInArrow(_pair_counts(word_bits), "bucket int, low binary, f binary").repartition("bucket").sortWithinPartitions("bucket")
    pairs = durable(buckets.mapInArrow(_pair_sums, "h int, f long"))
    pair_bits = context.broadcast(bitmap(pairs))
    # 1 / VERY_FREQUENT words and as many pairs at most.
    much = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * VERY_FREQUENT
    words_cut, pairs_cut = (np.sort(np.array([row["h"] for row in rows.where(F.col("f") > much).collect()], np.int64)).view(np.uint64) for rows in (hashed, pairs))
    found = texts.mapInArrow(_occurrences(word_bits, pair_bits, words_cut, pairs_cut), "lang string, words string, n long, cut byte")
    task = F.expr("xxhash64(lang, substring_index(words, ' ', 1 + cut))")
    grown = found.repartition(task).sortWithinPartitions("lang", "words").mapInArrow(_grow, "lang string, phrase string, f long")
    grown = grown.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= LEAST)
    return totals, durable(words.unionByName(grown))


def report(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the BEST highest-scoring phrases of 2 to LONGEST words of each language.

    a, l, r: occurrences of the phrase and of its two parts at the lowest-scoring cut; n: all words of the language. Phrases lie within
    pieces of the texts, and a phrase that a longer one covers (COVERED hundredths of its occurrences or more) is left out. Null texts
    have no words; a null lang counts as `und`. Documents count as often as they are there, and no column but lang and text plays a
    part. An empty table, or one without frequent phrases, gives no rows.
    """
    totals, phrases = frequent_phrases(docs)
    long = phrases.withColumn("words", F.split("phrase", " ")).withColumn("k", F.size("words"))
    candidates = durable(long.where("k > 1").withColumnRenamed("f", "a"))
    cut = candidates.select("lang", "phrase", "a", "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.withColumn("left", F.array_join(F.slice("words", 1, F.col("cut")), " ")).withColumn("right", F.array_join(F.slice("words", F.col("cut") + 1, F.col("k")), " "))
    cut = cut.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = cut.withColumn("score", F.expr(f"cast(cast(a as decimal(20, 0)) * {SCALE} div (cast(l as decimal(20, 0)) + r) as long)"))
    lowest = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    # Every run of two words or more inside a longer candidate.
    start = F.sequence(F.lit(1), F.col("k") - 1)
    inside = candidates.where("k > 2").select("lang", F.col("a").alias("f"), "words", "k", F.explode(start).alias("from")).select("lang", "f", "words", "k", "from", F.explode(F.sequence(F.lit(2), F.col("k") + 1 - F.col("from"))).alias("size"))
    inside = inside.where("size < k").select("lang", F.array_join(F.slice("words", F.col("from"), F.col("size")), " ").alias("phrase"), "f")
    covering = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = lowest.join(covering, ["lang", "phrase"], "left").where(f"most is null or cast(most as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {COVERED}")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score").withColumn("rank", rank.cast("long")).where(F.col("rank") <= BEST)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH p AS (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
), w AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p
), g AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), f AS (
    SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
    SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}
), cut AS (
    SELECT c.lang, c.phrase, c.a, x.cut, l.f AS l, r.f AS r, (c.a::HUGEINT * {SCALE} // (l.f + r.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) x JOIN c USING (lang, phrase)
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(x.w[1:x.cut], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(x.w[x.cut + 1:], ' ')
), low AS (
    SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
    FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL
), best AS (
    SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank
    FROM low LEFT JOIN inside i ON i.lang = low.lang AND i.phrase = low.phrase WHERE i.most IS NULL OR 100 * i.most::HUGEINT < {COVERED} * a::HUGEINT
)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang) WHERE rank <= {BEST}
"""
