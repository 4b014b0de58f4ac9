"""Benchmark decontamination with suffix arrays over the training words.

Each shard of documents gets a suffix array of its words.  Every suffix of the test items is
binary-searched in every shard, word by word: the search gives its longest verbatim match with a
place, and the places of all matches as long as a window.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import others, table
from pagemill.llm.tokens import ALNUM, LOWER, byte_rows, pieces, word_bounds, word_hashes

# parameters
WINDOW = 10
SHARD_BYTES = 512 << 10
ITEMS_BYTES = 8 << 20  # of test texts that are sent to the tasks at once

FOUND = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,end:int>>,longest:int,longest_item:string,longest_at:int>"
OWN = ["n_words", "n_hit", "items", "spans", "longest", "longest_item", "longest_at"]


def item_suffixes(names: list[str], texts: list[str | None]) -> SimpleNamespace:
    """All suffixes of the test items: codes of their words, item number, words left in and words of the item."""
    data, offsets = byte_rows(pa.array(texts, pa.string()))
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, ALNUM)
    sizes = np.diff(first)
    item = np.repeat(np.arange(len(names)), sizes)
    codes, left = word_hashes(data, starts, ends), first[1:][item] - np.arange(len(starts))
    return SimpleNamespace(codes=codes, item=item, left=left, size=sizes[item], names=names)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``codes``, sorted by their first ``depth`` words (the codes' high halves).

    Prefix doubling: two words at once to begin with; then only suffixes that still tie are sorted.
    """
    n = len(codes)
    high = codes >> np.uint64(32)
    after = np.append(high[1:], np.uint64(0))
    keys = (high << np.uint64(32)) | after
    order = np.argsort(keys)
    known, rank = 2, np.zeros(n + 1, np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = keys[order[1:]] != keys[order[:-1]]
    while True:
        group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order] = group + 1
        if known >= depth:
            return order
        alone = fresh & np.append(fresh[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        at = order[tied]
        finer = (group[tied].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at + known, n)].astype(np.uint64)
        by = np.argsort(finer, kind="stable")
        order[tied] = at[by]
        finer = finer[by]
        fresh[tied[1:]] |= finer[1:] != finer[:-1]
        known *= 2


def search(codes: np.ndarray, order: np.ndarray, tests: SimpleNamespace, window: int):
    """Binary search of every test suffix.

    Gives, per suffix, the length of its longest match and a place of it; and, for suffixes with a
    whole window in the shard, the range of ``order`` that starts with the window.
    """
    n, m = len(order), len(tests.codes)
    lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
    longest, place = np.zeros(m, np.int64), np.zeros(m, np.int64)
    need = np.minimum(window, tests.size)
    from_, to = np.zeros(m, np.int64), np.zeros(m, np.int64)
    active, depth = np.arange(m), 0
    high = codes >> np.uint64(32)
    while len(active):
        want = tests.codes[active + depth] >> np.uint64(32)
        bounds = []
        for upper in (False, True):
            a, b = lo[active].copy(), hi[active].copy()
            while True:
                open_ = a < b
                if not open_.any():
                    break
                mid = (a + b) >> 1
                at = order[np.minimum(mid, n - 1)] + depth
                have = np.where(at < n, high[np.minimum(at, n - 1)], 0)
                less = open_ & ((have <= want) if upper else (have < want))
                a = np.where(less, mid + 1, a)
                b = np.where(open_ & ~less, mid, b)
            bounds.append(a)
        lo[active], hi[active] = bounds
        active = active[bounds[0] < bounds[1]]
        depth += 1
        longest[active], place[active] = depth, order[lo[active]]
        whole = active[need[active] == depth]
        from_[whole], to[whole] = lo[whole], hi[whole]
        active = active[tests.left[active] > depth]
    return longest, place, from_, to


def _examine(data: np.ndarray, offsets: np.ndarray, tests: SimpleNamespace, window: int) -> dict[str, list]:
    """Columns of FOUND for the documents of one shard."""
    n_docs = len(offsets) - 1
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, ALNUM)
    n_words = np.diff(first)
    out = {
        "n_words": n_words.tolist(), "n_hit": [0] * n_docs, "items": [[] for _ in range(n_docs)], "spans": [[] for _ in range(n_docs)],
        "longest": [0] * n_docs, "longest_item": [None] * n_docs, "longest_at": [None] * n_docs,
    }
    if not len(starts) or not len(tests.codes):
        return out
    # one code of 0 ends each document, so that no match leaves it
    doc = np.repeat(np.arange(n_docs), n_words)
    codes = np.zeros(len(starts) + n_docs, np.uint64)
    at = np.arange(len(starts)) + doc
    codes[at] = word_hashes(data, starts, ends)
    owner = np.repeat(np.arange(n_docs), n_words + 1)
    begin = first[:-1] + np.arange(n_docs)
    order = suffix_array(codes, int(tests.left.max()))
    longest, place, lo, hi = search(codes, order, tests, window)
    for q in np.argsort(longest, kind="stable").tolist():  # the longest comes last and stays
        if longest[q]:
            d = int(owner[place[q]])
            if longest[q] >= out["longest"][d]:
                out["longest"][d], out["longest_item"][d] = int(longest[q]), tests.names[tests.item[q]]
                out["longest_at"][d] = int(place[q] - begin[d])
    whole = np.flatnonzero((hi > lo) & (tests.left >= np.minimum(window, tests.size)))
    counts = hi[whole] - lo[whole]
    query = np.repeat(whole, counts)
    steps = np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts)
    where = order[lo[query] + steps]
    width = np.minimum(window, tests.size[query])
    # codes were sorted by half their bits: compare them whole
    same = np.ones(len(query), bool)
    for k in range(int(width.max(initial=0))):
        inside = width > k
        same[inside] &= codes[where[inside] + k] == tests.codes[query[inside] + k]
    query, where, width = query[same], where[same], width[same]
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, where, 1)
    np.add.at(cover, where + width, -1)
    hit = (np.cumsum(cover[:-1]) > 0) & (codes != 0)
    out["n_hit"] = np.bincount(owner, weights=hit, minlength=n_docs).astype(np.int64).tolist()
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        d = int(owner[a])
        out["spans"][d].append({"start": int(a - begin[d]), "end": int(b - begin[d])})
    for d, i in np.unique(np.stack([owner[where], tests.item[query]]), axis=1).T.tolist():
        out["items"][d].append(tests.names[i])
    out["items"] = [sorted(set(names)) for names in out["items"]]
    return out


def _finder(tests, window: int):
    kind = pa.struct(
        [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
         ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("longest", pa.int32()), ("longest_item", pa.string()), ("longest_at", pa.int32())]
    )

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        parts = [pa.array([], kind)]
        for _, _, data, offsets in pieces(texts, SHARD_BYTES):
            found = _examine(data, offsets, tests.value, window)
            parts.append(pa.StructArray.from_arrays([pa.array(found[f.name], f.type) for f in kind], fields=list(kind)))
        return pa.concat_arrays(parts)

    return find


def _merged(a, b):
    """Findings of two blocks of test items in one."""
    spans = F.sort_array(F.concat(a["spans"], b["spans"]))
    start = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(-1).alias("from"), F.lit(-1).alias("to"))

    def step(s, x):
        apart = x["start"] > s["to"]
        done = F.when(apart & (s["from"] >= 0), F.concat(s["done"], F.array(F.struct(s["from"].alias("start"), s["to"].alias("end"))))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(apart, x["start"]).otherwise(s["from"]).alias("from"), F.greatest(s["to"], x["end"]).alias("to"))

    def last(s):
        return F.when(s["from"] >= 0, F.concat(s["done"], F.array(F.struct(s["from"].alias("start"), s["to"].alias("end"))))).otherwise(s["done"])

    spans = F.aggregate(spans, start, step, last)
    hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    longer = b["longest"] > a["longest"]
    return F.struct(
        a["n_words"].alias("n_words"), hit.alias("n_hit"), F.array_sort(F.array_union(a["items"], b["items"])).alias("items"), spans.alias("spans"),
        *[F.when(longer, b[n]).otherwise(a[n]).alias(n) for n in ("longest", "longest_item", "longest_at")],
    )


def match_benchmark(docs: DataFrame, items: DataFrame, window: int = WINDOW, items_bytes: int = ITEMS_BYTES) -> DataFrame:
    """``docs`` with what they share with the test ``items`` (item_id, text).

    Adds n_words, n_hit (words inside matches of a window), items (ids, sorted as strings), spans
    (word ranges hit), and the longest verbatim match of any test suffix that was found in the document
    (where several documents of a shard hold it, one of them shows it): longest, longest_item,
    longest_at.  Columns of these names are replaced.  A window is ``window`` words; an item of fewer
    is one window, an item without words is none.  Null texts have no words; a null item id reads
    "null".  Items are taken in blocks of about ``items_bytes``, each sent to the tasks in turn;
    an item is never cut, so one larger item is a block by itself.  Rows stay as they are, equal or not.
    """
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // items_bytes))
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), "text")
    named = named.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n_blocks)))
    found = docs.select(*others(docs, [*OWN, "_found"]))
    for k in range(n_blocks):
        block = named.where(F.col("block") == k).orderBy("name").select("name", "text").collect()
        tests = docs.sparkSession.sparkContext.broadcast(item_suffixes([r[0] for r in block], [r[1] for r in block]))
        this = _finder(tests, window)(F.col("text"))
        if k == 0:
            found = found.withColumn("_found", this)
        else:
            found = found.withColumn("_next", this)
            found = found.withColumn("_found", _merged(F.col("_found"), F.col("_next"))).drop("_next")
    return found.select("*", "_found.*").drop("_found")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of any test item; see :func:`match_benchmark`."""
    return match_benchmark(docs, items, window).where(F.col("n_hit") == 0).drop(*OWN)


def op4_decontaminate(spark, sf_dir):
    """What each document shares with the benchmark in windows of ten words."""
    found = match_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), WINDOW)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS p FROM i WHERE len(w) > 0)
),
widths AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, widths WHERE len(w) >= n)
),
hits AS (SELECT doc_id, item_id, p, dw.n FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
words AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS word FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
