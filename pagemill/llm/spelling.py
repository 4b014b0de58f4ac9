"""Spelling variants: words one edit apart, found with grams of variable length.

Grams that are frequent among the words are of little use to tell them apart, so the gram dictionary keeps
them only as beginnings of longer ones.  At each place of a word stands the shortest gram that is
not frequent (or of full length).  An edit touches only the grams that cover its place, so the greatest number
of grams over one place bounds, word by word, how many grams an edit can change.  The lists of words of a
gram are then merged: near words share one of their rarest grams, and all but that bound of the rest.

Unlike in a decomposition that drops grams inside earlier ones, a gram stands at every place: which
gram that is depends on its own letters alone, which keeps the bound small for short words.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import discard, store, table

# parameters
MIN_CHARS, MIN_COUNT = 6, 5
TYPO_RATIO = 5  # a form occurs so many times as often
LEAST_GRAM, MOST_GRAM = 2, 5
FREQUENT_GRAMS = 50_000  # of each length at most: the dictionary that is broadcast holds no more

# fixed values: the letters of a run, and what stands behind a word's end
RUN = "[a-zÀ-ÿ]"
END = "$"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, typo_every: int | None = 199) -> DataFrame:
    """(word, n) of the words of ``min_chars`` letters and ``min_count`` occurrences.

    Words are the runs of letters, without capitals A-Z.  With ``typo_every``, one letter is left out of the runs
    whose CRC-32 of ``id:run`` it divides, at the remainder of the CRC-32 by the run's length; a null id counts as ''.
    Only built-in functions; words are counted before they are shuffled.
    """
    low = F.translate(F.col("text"), UPPER, LOWER)
    # a shorter run can only become shorter still
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(f"{RUN}{{{min_chars},}}"), F.lit(0))).alias("run"))
    word = F.col("run")
    if typo_every:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
        at = F.pmod(F.col("h"), F.length("run")).cast("int")
        runs = runs.withColumn("h", h)
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % typo_every == 0, cut).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def frequent_grams(words: DataFrame, most: int, at_most: int = FREQUENT_GRAMS) -> dict[str, int]:
    """Grams of LEAST_GRAM to ``most`` letters that occur too often in the words, with their counts.

    Of each length there are fewer than ``at_most``, as each of them takes more than that share of all places.
    """
    padded = words.select(F.concat("word", F.lit(END)).alias("p"))
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(LEAST_GRAM), F.lit(most)),
            lambda q: F.transform(F.sequence(F.lit(1), F.length("p") - q + 1), lambda i: F.substring("p", i, q)),
        )
    )
    places = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    counted = padded.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return dict(map(tuple, counted.where(F.col("n") > places // at_most).toLocalIterator()))


def decomposed(word: str, frequent: dict[str, int], most: int) -> tuple[list[str], int]:
    """(grams, bound): the gram at each place of a word, and how many of them one edit can change."""
    padded = word + END
    grams, cover = [], [0] * (len(padded) + 1)
    for p in range(len(word)):
        end = min(p + LEAST_GRAM, len(padded))
        while end - p < most and end < len(padded) and padded[p:end] in frequent:
            end += 1
        grams.append(padded[p:end])
        cover[p] += 1
        cover[end] -= 1
    bound = here = 0
    for step in cover:
        here += step
        bound = max(bound, here)
    return grams, bound


def probes(word: str, frequent: dict[str, int], most: int) -> tuple[list[int], int, list[tuple[str, int, int]]]:
    """(tokens, need, rarest): hashes of all numbered grams, how many a near word shares, and the rarest of them.

    Of t + b grams with at least t shared, the b + 1 rarest hold a shared one, in the same order for all words.
    ``rarest`` has (gram, number among equal ones, place); the place is -1 for a gram that occurs twice.
    """
    grams, bound = decomposed(word, frequent, most)
    seen: dict[str, int] = {}
    numbered = []
    for p, gram in enumerate(grams):
        seen[gram] = seen.get(gram, 0) + 1
        numbered.append((frequent.get(gram, 0), gram, seen[gram], p))
    numbered.sort()
    tokens = [xxhash.xxh32_intdigest(f"{gram} {k}") - (1 << 31) for _, gram, k, _ in numbered]
    rarest = [(gram, k, p if seen[gram] == 1 else -1) for _, gram, k, p in numbered[: bound + 1]]
    return tokens, len(grams) - bound, rarest


def near_pairs(words: DataFrame, min_chars: int, at_most: int = FREQUENT_GRAMS) -> DataFrame:
    """(a, na, b, nb): all pairs of (word, n) one insertion, deletion or replacement apart, in both orders.

    Grams are shorter than the shortest word, so that near words always share one.  A list of words is split by
    word length; it is joined with itself from stored tables, where Spark splits one that is long.
    """
    if min_chars <= LEAST_GRAM:
        raise ValueError(f"words must have more than {LEAST_GRAM} letters")
    most = min(MOST_GRAM, min_chars - 1)
    frequent = words.sparkSession.sparkContext.broadcast(frequent_grams(words, most, at_most))
    schema = "word string, n bigint, len int, tokens array<int>, need int, rarest array<struct<gram:string,k:int,p:int>>"
    rare = pa.struct([("gram", pa.string()), ("k", pa.int32()), ("p", pa.int32())])

    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = batch.column("word").to_pylist()
            found = [probes(word, frequent.value, most) for word in spelled]
            rarest = [[{"gram": g, "k": k, "p": p} for g, k, p in r] for _, _, r in found]
            yield pa.RecordBatch.from_pydict({
                "word": batch.column("word"), "n": batch.column("n"), "len": pa.array(list(map(len, spelled)), pa.int32()),
                "tokens": pa.array([t for t, _, _ in found], pa.list_(pa.int32())),
                "need": pa.array([n for _, n, _ in found], pa.int32()), "rarest": pa.array(rarest, pa.list_(rare)),
            })

    listed = words.select("word", "n").mapInArrow(decompose, schema).withColumn("r", F.explode("rarest"))
    # the longer word of a pair looks among words of its own length, and among those one shorter
    listed = listed.select("word", "n", "len", "tokens", "need", F.explode(F.array(F.lit(0), F.lit(1))).alias("more"), "r")
    key = F.xxhash64("r.gram", "r.k", F.col("len") + F.col("more"))
    lists = store(listed.select(key.alias("key"), "word", "n", "more", "tokens", "need", F.col("r.p").alias("p")), "gram-lists")
    long, short = lists.where("more = 0").alias("x"), lists.alias("y")
    same_place = (F.col("x.p") < 0) | (F.col("y.p") < 0) | (F.abs(F.col("x.p") - F.col("y.p")) <= 1)
    shared = F.size(F.array_intersect("x.tokens", "y.tokens")) >= F.greatest("x.need", "y.need")
    once = (F.col("y.more") == 1) | (F.col("x.word") < F.col("y.word"))
    merged = long.join(short, (F.col("x.key") == F.col("y.key")) & once & same_place & shared)
    pairs = merged.where(F.levenshtein("x.word", "y.word", 1) == 1)
    pairs = pairs.select(F.col("x.word").alias("a"), F.col("x.n").alias("na"), F.col("y.word").alias("b"), F.col("y.n").alias("nb")).distinct()
    stored = store(pairs, "near-words")
    discard(lists)
    return stored.unionByName(stored.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, ...) with root: where following the forms ends, the word itself without one.

    Each round doubles the steps taken.  As a form occurs several times as often as its word, chains are short, whatever
    the number of words: counts below 2**63 allow 27 steps at a ratio of 5, which five rounds reach.
    """
    steps = store(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = store(steps.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "forms")
        discard(steps)
        steps = moved.select("word", "root")
        steps.stored_at = moved.stored_at
        if moved.where("_moved").isEmpty():
            return forms.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    ratio: int = TYPO_RATIO,
    typo_every: int | None = None,
    at_most: int = FREQUENT_GRAMS,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root): the words of ``docs`` (doc_id, text) and what they are variants of.

    Words as in :func:`word_counts`.  n_near counts the other words one edit of a code point away; the form is the most
    frequent of them (of equals the first by code point) if it occurs at least ``ratio`` times as often, else null;
    the root is where the chain of forms ends.  Null texts have no words, repeated rows count each time, other columns
    are not used, a table without words gives an empty result.
    """
    words = store(word_counts(docs, min_chars, min_count, typo_every), "words")
    best = F.min(F.struct((-F.col("nb")).alias("least"), F.col("b").alias("b")))
    near = near_pairs(words, min_chars, at_most).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    is_form = -F.col("best.least") >= ratio * F.col("n")
    forms = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best.b")).alias("form"), F.when(is_form, -F.col("best.least")).alias("form_n"),
    )
    return with_roots(store(forms, "variants"))


def op11_spelling_variants(spark, sf_dir):
    """Words of all documents, every 199th or so with a letter left out, grouped by spelling."""
    found = spelling_variants(table(spark, sf_dir, "documents"), MIN_CHARS, MIN_COUNT, TYPO_RATIO, typo_every=199)
    return found.select("word", "form", "root", "n", "n_near", "form_n")
