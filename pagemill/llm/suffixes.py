"""Suffix-array deduplication of byte strings, by induced sorting.

Windows of the text are dealt to shards by their anchor, the 32-byte gram with the least hash, so
that equal windows of all documents meet in one shard.  Each shard's fragments get a suffix array by
induced sorting; neighbours in it are compared directly, eight bytes at a time and up to a window,
as windows that share a prefix as long as themselves are repeats of the earliest.  No permuted
(text-order) array is computed: the comparison is cut at a window and runs on all neighbours at once
in NumPy, where the text-order method goes from one suffix to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import discard, keyed, store, table
from pagemill.llm.tokens import MULTIPLIERS, pieces, run_hashes

# parameters
WINDOW = 100
GRAM = 32
PIECE_BYTES = 256 << 10
SHARD_BYTES = 512 << 10
HOT_CONTENTS = 16_384


# --- suffix arrays


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end of the text is smallest."""
    n = len(text)
    last = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)  # ends of runs of one byte
    rises = np.append(text[last[:-1]] < text[last[:-1] + 1], False)
    return np.repeat(rises, np.diff(np.append(-1, last)))


def induce(text: np.ndarray, small: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order of all suffixes, from the order ``small`` of the leftmost smaller ones.

    Larger suffixes are induced bucket by bucket in ascending order of first bytes, smaller ones
    in descending order.  Within a bucket, suffixes that start with a run of its byte follow wave by wave.
    """
    n, symbols = len(text), len(sizes)
    heads = np.cumsum(sizes) - sizes
    ends = heads + sizes
    order = np.full(n, -1, np.int32)
    lms = np.searchsorted(text[small], np.arange(symbols + 1))  # small is sorted by first byte
    at = heads.copy()

    def deal(before: np.ndarray, symbol: np.ndarray) -> None:
        """Append positions to the fronts of their buckets, in order."""
        if len(before):
            by = np.argsort(symbol, kind="stable")
            symbol, counts = symbol[by], np.bincount(symbol, minlength=symbols)
            order[at[symbol] + np.arange(len(by)) - (np.cumsum(counts) - counts)[symbol]] = before[by]
            at[:] += counts

    def deal_back(before: np.ndarray, symbol: np.ndarray) -> None:
        """The same to the backs, each bucket from its end."""
        if len(before):
            by = np.argsort(symbol, kind="stable")
            symbol, counts = symbol[by], np.bincount(symbol, minlength=symbols)
            order[at[symbol] - 1 - (np.arange(len(by)) - (np.cumsum(counts) - counts)[symbol])] = before[by]
            at[:] -= counts

    deal(np.array([n - 1], np.int32), text[n - 1 :])  # the last byte precedes the end of the text
    for c in np.flatnonzero(sizes).tolist():
        done = heads[c]
        while done < at[c]:
            wave = order[done : at[c]]
            done = at[c]
            before = wave[wave > 0] - 1
            before = before[text[before] >= c]
            deal(before, text[before])
        wave = small[lms[c] : lms[c + 1]]
        before = wave[wave > 0] - 1
        deal(before, text[before])
    at[:] = ends
    for c in np.flatnonzero(sizes)[::-1].tolist():
        done = ends[c]
        while done > at[c]:
            wave = order[at[c] : done][::-1]
            done = at[c]
            before = wave[wave > 0] - 1
            before = before[text[before] <= c]
            deal_back(before, text[before])
        wave = order[heads[c] : at[c]][::-1]  # the larger ones of this bucket
        before = wave[wave > 0] - 1
        before = before[text[before] < c]
        deal_back(before, text[before])
    return order


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """At each place its 8 symbols in one number, first symbol highest; zeros follow the end."""
    n = len(text)
    out = np.zeros(n + 8, np.uint64)
    out[:n] = text
    for step in (1, 2, 4):
        out[: n + 8 - step] = (out[: n + 8 - step] << np.uint64(8 * step)) | out[step:]
    return out


def sorted_names(rank: np.ndarray, order: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names by doubling: those that tie are sorted by what follows."""
    n, known = len(rank), 1
    rank = np.append(rank, -1)
    while True:
        group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order] = group
        tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(tied):
            return order
        at = order[tied]
        finer = (group[tied].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(at + known, n)] + 1).astype(np.uint64)
        by = np.argsort(finer, kind="stable")
        order[tied], finer = at[by], finer[by]
        fresh[tied[1:]] |= finer[1:] != finer[:-1]
        known *= 2


def suffix_array(text: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Starts of all suffixes of a byte array in order; a suffix is smaller than those it begins."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32)
    sizes = np.bincount(text, minlength=256)
    smaller = suffix_types(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + np.int32(1)
    if len(lms) > 1:
        words = eight_bytes(text) if words is None else words
        rough = lms[np.argsort(text[lms], kind="stable")]
        order = induce(text, rough, sizes)
        number = np.full(n, -1, np.int32)
        number[lms] = np.arange(len(lms))
        ranked = number[order]
        ranked = ranked[ranked >= 0]  # leftmost smaller substrings, sorted
        length = np.append(np.diff(lms) + 1, n - lms[-1] + 1)
        a, b = ranked[:-1], ranked[1:]
        same = np.flatnonzero(length[a] == length[b])
        equal = np.zeros(len(ranked), bool)
        at = 0
        while len(same):
            left = length[a[same]] - at
            shift = (8 * np.maximum(0, 8 - left)).astype(np.uint64)
            same = same[(words[lms[a[same]] + at] >> shift) == (words[lms[b[same]] + at] >> shift)]
            at += 8
            ended = length[a[same]] <= at
            equal[same[ended] + 1] = True
            same = same[~ended]
        names = np.empty(len(lms), np.int64)
        names[ranked] = np.cumsum(~equal) - 1
        lms = lms[sorted_names(names, ranked.astype(np.int64), ~equal)]
    return induce(text, lms, sizes)


def common_prefixes(order: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """By place in ``order``: the length of the prefix shared with the one before, cut at ``most``."""
    out = np.zeros(len(order), np.int64)
    live, at = np.arange(1, len(order)), 0
    while len(live) and at < most:
        x, y = (words[np.minimum(order[k] + at, len(words) - 1)] for k in (live, live - 1))
        x = x ^ y
        # whole leading bytes that agree
        agree = sum((x < np.uint64(1 << bits)).astype(np.int64) for bits in range(8, 64, 8)) + (x == 0)
        some = x != 0
        out[live] += agree
        live = live[~some]
        at += 8
    return np.minimum(out, most)


# --- shards


def _anchored(window: int, hashed: bool = True):
    """Arrow step: fragments (anchor, k1, k2, document, place, length), each all windows of one anchor.

    k1 and k2 are 128 bits of hash of the fragment's bytes, 0 if they are not asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = window - GRAM + 1
        for batch in batches:
            ids, hashes = batch.column("_id").to_numpy(), batch.column("_th").to_numpy()
            for begin, _, data, offsets in pieces(batch.column("text"), PIECE_BYTES):
                if len(data) < window:
                    continue
                h = run_hashes(data.astype(np.uint64) + np.uint64(1), GRAM, MULTIPLIERS[0])
                # 33 bits of hash, then the place: the leftmost of the least
                key = (h & ~np.uint64((1 << 31) - 1)) | np.arange(len(h), dtype=np.uint64)
                n = len(data) - window + 1
                size = -(-len(key) // grams) * grams
                padded = np.full(size, np.iinfo(np.uint64).max)
                padded[: len(key)] = key
                table_ = padded.reshape(-1, grams)
                ahead = np.minimum.accumulate(table_, axis=1).ravel()
                back = np.minimum.accumulate(table_[:, ::-1], axis=1)[:, ::-1].ravel()
                least = np.minimum(back[:n], ahead[grams - 1 : grams - 1 + n]) & np.uint64((1 << 31) - 1)
                starts = np.arange(n)
                doc = np.searchsorted(offsets, starts, "right") - 1
                inside = starts + window <= offsets[doc + 1]
                starts, least, doc = starts[inside], least[inside].astype(np.int64), doc[inside]
                if not len(starts):
                    continue
                new = np.append(0, np.flatnonzero((least[1:] != least[:-1]) | (doc[1:] != doc[:-1])) + 1)
                last = np.append(new[1:], len(starts)) - 1
                k1 = k2 = np.zeros(len(new), np.int64)
                if hashed:
                    raw, bounds = data.tobytes(), zip(starts[new].tolist(), (starts[last] + window).tolist(), strict=True)
                    k1, k2 = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in bounds), np.int64).reshape(-1, 2).T.copy()
                columns = {
                    "anchor": h[least[new]].view(np.int64), "k1": k1, "k2": k2, "_id": ids[begin + doc[new]], "_th": hashes[begin + doc[new]],
                    "at": (starts[new] - offsets[doc[new]]).astype(np.int32), "len": (starts[last] - starts[new] + window).astype(np.int32),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return run


FRAGMENT = "anchor bigint, k1 bigint, k2 bigint, _id bigint, _th bigint, at int, len int"


def repeated_in_shard(contents: list[bytes], documents: list, places: list[int], window: int) -> list[list[tuple[int, int]]]:
    """For each content, runs (start, end) of its windows that occur earlier in the shard.

    A window's place in the corpus is its content's first document (any order of values) and place there.
    """
    text = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    begin = np.cumsum(sizes + 1) - sizes - 1
    words = eight_bytes(text)
    order = suffix_array(text, words)
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    within = np.arange(len(text)) - begin[owner]
    order = order[within[order] + window <= sizes[owner[order]]]
    prefix = common_prefixes(order, words, window)
    group = np.flatnonzero(prefix < window)
    number = {d: i for i, d in enumerate(sorted(set(documents)))}
    rank = np.array([number[d] for d in documents], np.int64)
    key = (rank[owner[order]] << 32) + np.asarray(places, np.int64)[owner[order]] + within[order]
    earliest = np.repeat(np.minimum.reduceat(key, group), np.diff(np.append(group, len(order)))) if len(order) else key
    repeat = np.zeros(len(text) + 1, np.int8)
    repeat[order[key > earliest]] = 1
    edge = np.diff(repeat, prepend=0)
    out: list[list[tuple[int, int]]] = [[] for _ in contents]
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        out[owner[a]].append((int(within[a]), int(within[a]) + b - a - 1 + window))
    return out


REPEATS = "anchor bigint, k1 bigint, k2 bigint, runs array<struct<start:int,end:int>>"


def _shard_step(window: int):
    """Arrow step over contents sorted by shard."""
    kind = pa.schema([("anchor", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def examined(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        anchors = rows["anchor"].to_numpy()
        _, at, counts = np.unique(anchors, return_inverse=True, return_counts=True)
        rows = rows.filter(pa.array(counts[at] > 1))  # a content alone with its anchor has no repeats
        if not rows.num_rows:
            return
        documents = list(zip(rows["_id"].to_pylist(), rows["_th"].to_pylist(), strict=True))
        runs = repeated_in_shard(rows["content"].to_pylist(), documents, rows["at"].to_pylist(), window)
        some = [i for i, r in enumerate(runs) if r]
        found = rows.select(["anchor", "k1", "k2"]).take(pa.array(some, pa.int64()))
        runs = pa.array([[{"start": a, "end": b} for a, b in runs[i]] for i in some], kind.field("runs").type)
        yield from found.append_column("runs", runs).cast(kind).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting = None, []
        for batch in batches:
            ids = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if ids[a] != shard and waiting:
                    yield from examined(pa.Table.from_batches(waiting))
                    waiting = []
                shard = ids[a]
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield from examined(pa.Table.from_batches(waiting))

    return run


def _hot_repeats(contents: DataFrame, window: int) -> DataFrame:
    """The same runs for contents of anchors too frequent for one shard, by hashes of all their windows."""
    at = F.posexplode(F.sequence(F.lit(0), F.length("content") - window))
    windows = contents.select("anchor", "k1", "k2", "_id", "_th", "at", "content", at.alias("i", "start"))
    part = F.substring("content", F.col("start") + 1, F.lit(window))
    place = F.struct("_id", "_th", (F.col("at") + F.col("start")).alias("at")).alias("place")
    windows = store(windows.select("anchor", "k1", "k2", "start", F.xxhash64(part).alias("w1"), F.xxhash64(F.lit(1), part).alias("w2"), place), "hot-windows")
    firsts = store(windows.groupBy("anchor", "w1", "w2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "hot-firsts")
    later = windows.join(firsts, ["anchor", "w1", "w2"]).where("place > first")
    one = F.struct(F.col("start").alias("start"), (F.col("start") + window).alias("end"))
    return later.groupBy("anchor", "k1", "k2").agg(F.collect_list(one).alias("runs"))


def repeated_bytes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_id, _th, spans): byte ranges of each document covered by windows that start earlier in the corpus."""
    spark = docs.sparkSession
    texts = keyed(docs.select("doc_id", "text")).select("_id", "_th", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    anchors = texts.mapInArrow(_anchored(window, hashed=False), FRAGMENT).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    shared = store(anchors.where("n > 1").select("anchor"), "shared-anchors")
    slim = store(texts.mapInArrow(_anchored(window), FRAGMENT).join(shared, "anchor", "left_semi"), "places")
    discard(shared)
    # the earliest of equal contents stands for all; only anchors with different contents need the bytes of each
    firsts = slim.groupBy("anchor", "k1", "k2").agg(F.min(F.struct("_id", "_th", "at", "len")).alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = store(firsts.select("anchor", "k1", "k2", "copies", "first.*"), "contents")
    several = store(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("size")).where("n > 1"), "several-contents")
    size, some_hot = several.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)) > HOT_CONTENTS).first()
    needed = firsts.join(several.select("anchor", "n"), "anchor").select("_id", "_th", F.struct("anchor", "k1", "k2", "at", "len", "n").alias("f"))
    needed = store(needed.groupBy("_id", "_th").agg(F.collect_list("f").alias("f")), "needed")  # of one document
    cut = texts.dropDuplicates(["_id", "_th"]).join(needed, ["_id", "_th"]).select("_id", "_th", "text", F.explode("f").alias("f"))
    cut = cut.select("_id", "_th", "f.*", F.substring("text", F.col("f.at") + 1, F.col("f.len")).alias("content"))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-size // SHARD_BYTES)))).alias("shard")
    cold = cut.where(F.col("n") <= HOT_CONTENTS).select(shard, "anchor", "k1", "k2", "_id", "_th", "at", "content")
    sharded = cold.repartition("shard").sortWithinPartitions("shard", "anchor")
    runs = sharded.mapInArrow(_shard_step(window), REPEATS)
    if some_hot:
        runs = runs.unionByName(_hot_repeats(cut.where(F.col("n") > HOT_CONTENTS), window))
    runs = store(runs, "runs")
    key = ["anchor", "k1", "k2"]
    heads = firsts.select(*key, "copies", F.struct("_id", "_th", "at").alias("first")).join(runs, key, "left")
    heads = store(heads.where("copies > 1 OR runs IS NOT NULL"), "heads")
    discard(firsts, runs, several, needed)
    places = slim.join(heads, key)
    earliest = F.struct("_id", "_th", "at") == F.col("first")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("len").alias("end")))
    places = places.select("_id", "_th", "at", F.explode(F.when(earliest, F.col("runs")).otherwise(whole)).alias("r"))
    span = F.struct((F.col("at") + F.col("r.start")).alias("start"), (F.col("at") + F.col("r.end")).alias("end"))
    spans = store(places.groupBy("_id", "_th").agg(F.collect_set(span).alias("spans")), "byte-spans")
    discard(slim, heads)
    return spans


KEPT = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>"


def _cutter():
    @F.arrow_udf(KEPT)
    def cut_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
        """Each text's bytes without those in its spans, with counts; spans that touch are one."""
        rows = []
        for text, ranges in zip(texts, spans, strict=True):
            text = text.as_py() or b""
            n, removed, count = len(text), 0, 0
            if ranges.is_valid:
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, np.asarray(ranges.values.field("start")), 1)
                np.add.at(change, np.asarray(ranges.values.field("end")), -1)
                gone = np.cumsum(change[:-1]) > 0
                removed, count = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                text = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append({"n_bytes": n, "n_removed": removed, "n_spans": count, "kept": text})
        return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))

    return cut_spans


def suffix_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text's bytes without repeated strings.

    A byte goes if a string of ``window`` bytes over it also starts earlier: in a document of smaller
    id (null last; among equal ids, of smaller text hash), or before in the same document.  Strings
    never cross documents.  Rows equal in id and text are one document and agree.  Null and empty
    texts have no bytes.  What is kept may cut a character, so it is binary.  Other columns are not used; an
    empty table gives an empty result.
    """
    if window < 2 * GRAM:
        raise ValueError(f"window must be at least {2 * GRAM} bytes")
    rows = keyed(docs.select("doc_id", "text")).join(repeated_bytes(docs, window), ["_id", "_th"], "left")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return rows.select("doc_id", _cutter()(text, F.col("spans")).alias("r")).select("doc_id", "r.*")


def op10_suffix_dedup(spark, sf_dir):
    """Bytes of 100-byte strings that occur earlier are removed."""
    result = suffix_dedup(table(spark, sf_dir, "documents"))
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
