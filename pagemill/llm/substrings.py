"""Removal of long passages that repeat across documents, found by difference-cover anchors.

A difference cover modulo v holds, for any two places, an offset below v that brings both to covered
positions.  So it is enough to hash short windows at covered positions: any two equal long windows
share such an anchor at the same offset.  Anchors that occur in two documents are extended to the long
windows around them, which are compared by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import discard, keyed, store, table
from pagemill.llm.tokens import MULTIPLIERS, NOT_SPACE, pieces, run_hashes, word_bounds, word_hashes

# parameters
WINDOW = 50
# fixed values: a difference cover (period 31); all differences modulo 31 occur
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
PIECE_BYTES = 256 << 10


def _words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a batch: (first row, end row, word codes, first word of each row and the end)."""
    for begin, end, data, offsets in pieces(texts, PIECE_BYTES):
        starts, ends, first = word_bounds(data, offsets, NOT_SPACE)
        yield begin, end, word_hashes(data, starts, ends), first


def _anchors(window: int):
    width = window - PERIOD + 1
    covered = np.isin(np.arange(PERIOD), COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("_id").to_numpy(), batch.column("_th").to_numpy()
            for begin, end, codes, first in _words(batch.column("text")):
                sizes = np.diff(first)
                doc = np.repeat(np.arange(begin, end), sizes)
                at = np.arange(len(codes)) - np.repeat(first[:-1], sizes)
                room = np.repeat(sizes, sizes)
                take = np.flatnonzero(covered[at % PERIOD] & (at + width <= room) & (room >= window))
                if len(take):
                    anchor = run_hashes(codes, width, MULTIPLIERS[1])[take].view(np.int64)
                    columns = {"anchor": anchor, "_id": ids[doc[take]], "_th": hashes[doc[take]], "at": at[take].astype(np.int32)}
                    yield pa.RecordBatch.from_pydict(columns)

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("_id").to_numpy(), batch.column("_th").to_numpy()
            lists = batch.column("anchors")
            flat, cuts = lists.flatten().to_numpy().astype(np.int64), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            for begin, end, codes, first in _words(batch.column("text")):
                mine = flat[cuts[begin] : cuts[end]]
                doc = np.repeat(np.arange(end - begin), np.diff(cuts[begin : end + 1]))
                marked = np.zeros(len(codes) + 1, bool)
                for back in range(PERIOD):
                    start = mine - back
                    fits = (start >= 0) & (start + window <= np.diff(first)[doc])
                    marked[first[doc[fits]] + start[fits]] = True
                start = np.flatnonzero(marked)
                if len(start):
                    doc = np.searchsorted(first, start, "right") - 1
                    w1, w2 = (run_hashes(codes, window, m)[start].view(np.int64) for m in MULTIPLIERS[1:])
                    columns = {"w1": w1, "w2": w2, "_id": ids[begin + doc], "_th": hashes[begin + doc], "at": (start - first[doc]).astype(np.int32)}
                    yield pa.RecordBatch.from_pydict(columns)

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_id, _th, starts): of each document, the windows whose words also start in a document of smaller id."""
    texts = keyed(docs.select("doc_id", "text"))
    texts = texts.select("_id", "_th", "text")
    anchors = texts.mapInArrow(_anchors(window), "anchor bigint, _id bigint, _th bigint, at int")
    shared = anchors.groupBy("anchor").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).where("low < high")
    shared = store(shared.select("anchor"), "shared-anchors")
    found = anchors.join(shared, "anchor", "left_semi").groupBy("_id", "_th").agg(F.collect_set("at").alias("anchors"))
    found = store(found, "anchored")
    near = texts.join(found, ["_id", "_th"])
    windows = store(near.mapInArrow(_windows(window), "w1 bigint, w2 bigint, _id bigint, _th bigint, at int"), "windows")
    discard(shared, found)
    firsts = store(windows.groupBy("w1", "w2").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).where("low < high"), "firsts")
    later = windows.join(firsts.select("w1", "w2", "low"), ["w1", "w2"]).where("_id > low")
    repeated = store(later.groupBy("_id", "_th").agg(F.collect_set("at").alias("starts")), "repeated")
    discard(windows, firsts)
    return repeated


KEPT = "struct<n_words:bigint,n_removed:bigint,kept:string>"


def _remover(window: int):
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    @F.arrow_udf(KEPT)
    def remove(texts: pa.Array, starts: pa.Array) -> pa.Array:
        rows = []
        for text, at in zip(texts.cast(pa.binary()), starts, strict=True):
            words = (text.as_py() or b"").split()
            n, gone = len(words), 0
            if at.is_valid:
                cover = np.zeros(n + 1, np.int64)
                at = np.asarray(at.values)
                cover[at] += 1
                np.add.at(cover, at + window, -1)
                stay = np.cumsum(cover[:-1]) == 0
                gone = int(n - stay.sum())
                words = [words[i] for i in np.flatnonzero(stay).tolist()]
            rows.append({"n_words": n, "n_removed": gone, "kept": b" ".join(words)})
        return pa.array(rows, pa.struct([*list(kind)[:2], ("kept", pa.binary())])).cast(kind)

    return remove


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text's words without those that earlier documents hold.

    A word goes if a window of ``window`` words over it also starts in a document of smaller id.
    Words are kept as they are, joined by one space.  Null and empty texts have no words.  A null id
    counts as largest; rows of one id don't take words from each other, so repeated rows
    agree.  Other columns are not used; an empty table gives an empty result.
    """
    if window < PERIOD + 1:
        raise ValueError(f"window must exceed {PERIOD} words")
    rows = keyed(docs.select("doc_id", "text")).join(repeated_windows(docs, window), ["_id", "_th"], "left")
    return rows.select("doc_id", _remover(window)(F.col("text"), F.col("starts")).alias("r")).select("doc_id", "r.*")


def op8_substring_dedup(spark, sf_dir):
    """Words of 50-word passages that occur in an earlier document are removed."""
    result = substring_dedup(table(spark, sf_dir, "documents"))
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM d WHERE len(w) >= 50)
),
firsts AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS pos
  FROM win JOIN firsts USING (h) WHERE doc_id > low
),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (
  SELECT doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone.pos IS NULL) AS s
  FROM words LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
