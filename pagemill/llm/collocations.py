"""Phrase collocations by marginalising the counts of the longest windows.

Every word begins one window: the word and the lead columns behind it, padded at the end of its piece.
Only these longest windows are counted; a ROLLUP over their columns sums them to ever shorter
prefixes, and as each occurrence of a phrase is the prefix of the window that begins with it,
that gives the counts of all phrases.

Windows end early where no phrase of enough occurrences can go on: before a word that would make a pair or
a triple which bitmaps of hashed counts show to be too rare.  They err on the side of longer windows
only, so no count that matters changes.  They have about half a bit for each word of the corpus, up to a bound;
in a corpus far beyond it they shorten less, and the windows are more.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import store, table
from pagemill.llm.tokens import LOWER, MULTIPLIERS, byte_rows, mixed, pieces, word_bounds, word_hashes
from pagemill.operators.joins import skew_safe_join

# parameters
LONGEST = 5  # words of a phrase
MIN_COUNT = 100
TOP = 2000
LEAST_BITS, MOST_BITS = 20, 30  # of each of the two bitmaps: 128 MB at most, whatever the corpus
PIECE_BYTES = 512 << 10
FOLD = 1 << 20  # hashes that a task gathers before it counts them
SALTS = 64  # groups in which a language's first are found before they meet

# fixed values: bytes between words, and those that end a piece
_BREAK = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])
_IN_WORD = ~(_BREAK | np.isin(np.arange(256), [0x20, 0x09]))
NO_LANG = "und"


class _Words:
    """The words of a run of texts: their hashes, rows, and whether the next word belongs to the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        self.starts, self.ends, first = word_bounds(self.data, offsets, _IN_WORD)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        breaks = np.cumsum(_BREAK[self.data])
        self.joined = np.zeros(len(self.starts), bool)
        if len(self.starts) > 1:
            self.joined[:-1] = (self.row[1:] == self.row[:-1]) & (breaks[self.starts[1:]] == breaks[self.starts[:-1]])

    def runs(self, n: int) -> np.ndarray:
        """A hash of each word and the ``n - 1`` behind it, of use where these belong to its piece."""
        h = self.hashes
        for k in range(1, n):
            h = mixed(h * np.uint64(MULTIPLIERS[1]) + np.roll(self.hashes, -k) * np.uint64(MULTIPLIERS[2]))
        return h


def _slots(runs: np.ndarray, seeds: np.ndarray, bits: int) -> np.ndarray:
    """The places of runs in a bitmap; ``seeds`` tell their languages apart."""
    return mixed(runs ^ seeds) >> np.uint64(64 - bits)


class Bitmap:
    """Which hashes of runs of words are frequent; a rare one may pass for frequent, never the other way round."""

    def __init__(self, data: np.ndarray):
        self.bytes, self.bits = data, len(data).bit_length() + 2

    def has(self, runs: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        slots = _slots(runs, seeds, self.bits)
        return (self.bytes[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _ahead(flags: np.ndarray, k: int) -> np.ndarray:
    """The flags of the words ``k`` places on."""
    return np.append(flags[k:], np.zeros(min(k, len(flags)), bool))


class _Known:
    """Frequent words and pairs (``joined`` ones) of a run of texts, as far as the bitmaps tell."""

    def __init__(self, words: _Words, seeds: np.ndarray, short: Bitmap):
        self.seeds = seeds[words.row]
        self.words = short.has(words.runs(1), self.seeds)
        self.pairs = self.words & _ahead(self.words, 1) & words.joined & short.has(words.runs(2), self.seeds)
        self.triples = self.pairs & _ahead(self.pairs, 1)


def _lang_seeds(langs: pa.DictionaryArray) -> np.ndarray:
    """A hash of each row's language."""
    data, offsets = byte_rows(langs.dictionary)
    seeds = word_hashes(data, offsets[:-1], offsets[1:]) if len(langs.dictionary) else np.zeros(0, np.uint64)
    return seeds[langs.indices.to_numpy()]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DictionaryArray, np.ndarray, _Words]]:
    """(languages, their seeds, words) of runs of rows of (lang, text)."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        seeds = _lang_seeds(langs)
        for at, end, data, offsets in pieces(batch.column("text"), PIECE_BYTES):
            yield langs.slice(at, end - at), seeds[at:end], _Words(data, offsets)


def _bitmap(texts: DataFrame, bits: int, min_count: int, runs: Callable[[_Words, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
    """The bytes of the bitmap of what ``runs`` gives of each run of texts: hashes and languages' seeds, counted over all of (lang, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)

        def flush() -> pa.RecordBatch:
            slots, n = np.unique(held, return_counts=True)
            return pa.RecordBatch.from_pydict({"slot": slots.astype(np.int64), "n": n.astype(np.int64)})

        for _, seeds, words in _parts(batches):
            held = np.concatenate([held, *(_slots(h, s, bits) for h, s in runs(words, seeds))])
            if len(held) > FOLD:
                yield flush()
                held = held[:0]
        yield flush()

    counts = texts.mapInArrow(counted, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    # Spark's bitmaps count from 1 and hold 32,768 bits each, so that at most 2^bits / 32,768 rows of 4 KB come back
    frequent = counts.where(F.col("n") >= min_count).select((F.col("slot") + 1).alias("s"))
    packed = frequent.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for b, m in packed.toLocalIterator():
        bitmap[(b - 1) * 4096 : b * 4096] = np.frombuffer(m, np.uint8)
    return bitmap


def window_counts(texts: DataFrame, longest: int, min_count: int) -> DataFrame:
    """(lang, w1, ..., n): how often each longest window occurs.

    Each word of a text counts in one window, the one that it begins; w2 and on are its lead columns, null behind
    the end of the piece and from where a word, a pair or a triple is too rare.  A word too rare itself has nulls only.
    The lead columns come from the order within the text, so that words are not shuffled for them.
    """
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, size / 12)))))
    context = texts.sparkSession.sparkContext

    def short_runs(words: _Words, seeds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        own = seeds[words.row]
        return [(words.runs(1), own), (words.runs(2)[words.joined], own[words.joined])]

    short = context.broadcast(_bitmap(texts, bits, min_count, short_runs))

    def triples(words: _Words, seeds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        known = _Known(words, seeds, Bitmap(short.value))
        return [(words.runs(3)[known.triples], known.seeds[known.triples])]

    long = context.broadcast(_bitmap(texts, bits, min_count, triples) if longest > 2 else None)
    columns = [f"w{k + 1}" for k in range(longest)]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, seeds, words in _parts(batches):
            n = len(words.hashes)
            if n == 0:
                continue
            known = _Known(words, seeds, Bitmap(short.value))
            triples = known.triples & Bitmap(long.value).has(words.runs(3), known.seeds) if longest > 2 else known.triples
            _, first, local = np.unique(words.hashes, return_index=True, return_inverse=True)
            # the number of each lead word, 0 for padding; the language is part of what is counted
            leads, here = np.zeros((longest, n), np.int64), known.words
            for k in range(min(longest, n)):
                leads[k, : n - k] = np.where(here[: n - k], local[k:] + 1, 0)
                here = here & _ahead(known.pairs, k) & (_ahead(triples, k - 1) if k else True)
            code = langs.indices.to_numpy()[words.row].astype(np.uint64)
            for lead in leads:
                code = mixed(code * np.uint64(MULTIPLIERS[0]) + lead.astype(np.uint64))
            _, at, counts = np.unique(code, return_index=True, return_counts=True)
            spelled = [None, *(words.data[words.starts[i] : words.ends[i]].tobytes() for i in first)]
            spelled = pa.array(spelled, pa.binary()).cast(pa.string())
            out = {"lang": langs.take(pa.array(words.row[at])).cast(pa.string())}
            out |= {name: spelled.take(pa.array(lead[at])) for name, lead in zip(columns, leads, strict=True)}
            yield pa.RecordBatch.from_pydict(out | {"n": pa.array(counts.astype(np.int64))})

    schema = ", ".join(f"{c} string" for c in ["lang", *columns]) + ", n bigint"
    return texts.mapInArrow(windows, schema).groupBy("lang", *columns).agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, m, phrase, f): all phrases of m = 1 to ``longest`` words with f >= ``min_count``, and for m = 0 each language's words.

    A ROLLUP sums the longest windows to their prefixes.  A prefix that ends in padding is no phrase.
    """
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    columns = [f"w{k + 1}" for k in range(longest)]
    summed = window_counts(texts, longest, min_count).rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # of lang and the words, the last ones summed up are ones of the grouping id
    m, last = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k in range(longest + 1):
        level = F.col("g") == (1 << (longest - k)) - 1
        m = F.when(level, k).otherwise(m)
        last = F.when(level, F.col(columns[k - 1]) if k else F.lit("")).otherwise(last)
    levels = summed.select("lang", m.alias("m"), last.alias("last"), F.concat_ws(" ", *columns).alias("phrase"), "f")
    kept = (F.col("m") == 0) | (F.col("last").isNotNull() & (F.col("f") >= min_count))
    return levels.where(F.col("m").isNotNull() & kept).select("lang", "m", "phrase", "f")


def _words(first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("words", first, n), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, top: int = TOP, share: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    ``docs`` has lang (null: ``und``) and text (null: empty).  Texts lose their capitals A-Z, are cut into pieces at
    ``. , ; : ! ?`` and line ends, these into words at blanks and tabs.  A phrase has 2 to ``longest`` words and
    a >= ``min_count`` occurrences; cut in two parts of l and r occurrences it scores floor(1000 a n / (l r)), n the
    language's words, and its worst cut counts, the earliest of equals.  Phrases inside one longer by any words whose count
    is at least ``share`` percent of theirs are left out.  Order: score, then a, descending, then the phrase's bytes.
    Repeated rows count each time; columns besides lang and text are not used; without words nothing comes back.
    """
    return ranked(store(phrase_counts(docs, longest, min_count), "phrases"), top, share)


def ranked(counts: DataFrame, top: int, share: int) -> DataFrame:
    """The collocations from ``counts`` of :func:`phrase_counts`, which should be a stored table."""
    totals = counts.where("m = 0").select("lang", F.col("f").alias("n"))
    known = counts.where("m > 0").select("lang", "phrase", "f")
    phrases = counts.where("m > 1").withColumn("words", F.split("phrase", " "))
    # what holds a phrase has its first or its last words: a count in between is no smaller than the longer one's
    parts = F.explode(F.array(_words(1, F.col("m") - 1), _words(2, F.col("m") - 1)))
    holders = phrases.where("m > 2").select("lang", parts.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_f"))
    alone = phrases.join(holders, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_f") < share * F.col("f"), F.lit(True)))
    cuts = alone.select("lang", "phrase", F.col("f").alias("a"), "words", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words(F.lit(1), F.col("k")).alias("left"), _words(F.col("k") + 1, F.col("m") - F.col("k")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    worst = skew_safe_join(cuts.select("lang", "phrase", "a", "k", "l", "r"), totals, "lang")
    wide = "decimal(17,0)"  # the products have 38 digits at most
    score = F.expr(f"1000 * cast(a AS {wide}) * cast(n AS {wide}) div (cast(l AS {wide}) * cast(r AS {wide}))")
    worst = worst.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n")).alias("c"))
    order = "ORDER BY c.score DESC, c.a DESC, phrase"
    # the first of each of some groups hold the first of all, so that no task sees a whole language
    best = worst.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = best.withColumn("_at", F.expr(f"row_number() OVER (PARTITION BY lang, _salt {order})")).where(F.col("_at") <= top)
    first = best.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("bigint")).where(F.col("rank") <= top)
    return first.select("lang", "rank", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")


def op13_collocations(spark, sf_dir):
    """The first 2,000 collocations of each language."""
    return collocations(table(spark, sf_dir, "documents"), LONGEST, MIN_COUNT, TOP)


OP13_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\n\x0B\x0C\r]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS words FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM worded, range(1, {LONGEST + 1}) AS lengths(m))
), counts AS (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= {MIN_COUNT}
), totals AS (
  SELECT lang, sum(len(words)) AS n FROM worded GROUP BY lang
), inside AS (
  SELECT DISTINCT lang, array_to_string(words[i:i + k - 1], ' ') AS phrase, f
  FROM (SELECT *, unnest(range(1, m - k + 2)) AS i
        FROM (SELECT *, string_split(phrase, ' ') AS words, unnest(range(2, m)) AS k FROM counts WHERE m > 2))
), alone AS (
  SELECT * FROM counts c WHERE m >= 2 AND NOT EXISTS (
    SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= 100 * c.f)
), cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(words[1:k], ' ') AS lhs, array_to_string(words[k + 1:m], ' ') AS rhs
  FROM (SELECT *, string_split(phrase, ' ') AS words, unnest(range(1, m)) AS k FROM alone)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
         (1000::HUGEINT * c.a * t.n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lhs JOIN counts y ON y.lang = c.lang AND y.phrase = c.rhs
  JOIN totals t ON t.lang = c.lang
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score
FROM worst QUALIFY rank <= {TOP}
"""
