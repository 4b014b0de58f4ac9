"""Quality classification by co-training of two views.

One view sees what a text says (its words and their shapes), the other what is known about it
(language, source, size, layout).  Each starts from the labelled rows; in every round each view labels
the unlabelled rows it is sure of, for the other view to learn from.  Both are then calibrated on
rows held out, combined, and score all documents.  Low quality and toxicity are learned apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import others, table
from pagemill.llm.tokens import ALNUM, LOWER, MULTIPLIERS, NOT_SPACE, mixed, pieces, word_bounds, word_hashes

# parameters; the three sizes bound what is learned from, scoring covers all rows
LABELLED = 12_000
POOL = 4_000
HELD_OUT = 5  # every fifth labelled row calibrates
ROUNDS = 2
SURE = 0.98  # of a pseudo-label
PSEUDO_WEIGHT = 0.5
BUCKETS = 1 << 18
MIN_ROWS = 5  # training rows that a word needs to count
REJECT = 0.5
PREFIXES = (4, 5)  # bytes of a word that are features besides the whole word
PIECE_BYTES = 256 << 10
TARGETS = ("low_quality", "toxic")

# fixed values: byte classes of a word's shape; other bytes stand for themselves
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:] = ord("0"), ord("A"), ord("a"), ord("a")
_SHARES = np.array([0.01, 0.05, 0.2, 0.5])
_KINDS = [_CLASS == ord("A"), _CLASS == ord("a"), _CLASS == ord("0"), ~NOT_SPACE, np.arange(256) == 10, np.arange(256) == ord("|"), np.arange(256) == ord("!")]
N_SIDE = 16  # hashed values of language and source
N_META = len(_KINDS) + 6 + 2 * N_SIDE


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(mask))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text in ``data``: sorted feature numbers with their row, and the layout part of the other view."""
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends, first = word_bounds(low, offsets, ALNUM)
    row = np.repeat(np.arange(n), np.diff(first))
    words = word_hashes(low, starts, ends)
    keys = [(row << 18) | (words % np.uint64(BUCKETS)).astype(np.int64)]
    distinct = np.bincount(np.unique(keys[0]) >> 18, minlength=n)
    for size in PREFIXES:  # words of one stem
        stems = mixed(word_hashes(low, starts, np.minimum(ends, starts + size)) + np.uint64(size))
        keys.append((row << 18) | (stems % np.uint64(BUCKETS)).astype(np.int64))
    # shapes: runs of a byte class collapsed; a shape counts with the share of words that have it
    begins, stops, from_ = word_bounds(data, offsets, NOT_SPACE)
    classes = _CLASS[data]
    turn = np.append(True, classes[1:] != classes[:-1])[: len(data)]
    turn[begins] = True
    place = np.append(0, np.cumsum(turn))
    shapes = word_hashes(classes[turn], place[begins], place[stops])
    of = np.repeat(np.arange(n), np.diff(from_))
    pairs, counts = np.unique((of << 18) | (shapes % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    level = np.searchsorted(_SHARES, counts / np.maximum(np.diff(from_), 1)[pairs >> 18], "right")
    shape = mixed(pairs.astype(np.uint64) % np.uint64(BUCKETS) * np.uint64(8) + level.astype(np.uint64) + np.uint64(1)) % np.uint64(BUCKETS)
    keys.append((pairs >> 18 << 18) | shape.astype(np.int64))
    keys = np.unique(np.concatenate(keys))
    size, n_words = np.diff(offsets).astype(np.float64), np.diff(from_).astype(np.float64)
    kinds = [_sums(k[data], offsets) / np.maximum(size, 1) for k in _KINDS]
    lines = _sums(data == 10, offsets) + 1
    layout = [*kinds, np.log1p(size), np.log1p(n_words), size / np.maximum(n_words, 1) / 10, distinct / np.maximum(np.diff(first), 1), np.log1p(size / lines), np.ones(n)]
    return keys & (BUCKETS - 1), keys >> 18, np.stack(layout, axis=1)


def side(lang: list, source: list) -> np.ndarray:
    """Hashed language and source, one column in 16 each."""
    out = np.zeros((len(lang), 2 * N_SIDE))
    for k, values in enumerate((lang, source)):
        codes = {v: int(mixed(np.array([int.from_bytes((v or "").encode()[-8:], "little")], np.uint64) * np.uint64(MULTIPLIERS[1]))[0] % N_SIDE) for v in set(values)}
        out[np.arange(len(values)), k * N_SIDE + np.array([codes[v] for v in values], int)] = 1
    return out


def views(texts: pa.Array, lang: pa.Array, source: pa.Array):
    """For each piece of a batch: (rows, feature numbers, their rows, other view)."""
    lang, source = lang.to_pylist(), source.to_pylist()
    for begin, end, data, offsets in pieces(texts, PIECE_BYTES):
        ids, row, layout = features(data, offsets)
        yield end - begin, ids, row, np.hstack([layout, side(lang[begin:end], source[begin:end])])


# --- learning, on bounded samples


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Sparse:
    """Rows of feature numbers."""

    def __init__(self, lists: list[np.ndarray]):
        self.lists = lists

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.array([w[ids].sum() for ids in self.lists]) + w[-1]


def fit_words(lists: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 5, rate: float = 1.0, l1: float = 8.0, l2: float = 0.1) -> np.ndarray:
    """Sparse logistic regression by follow-the-regularised-leader; the last weight is the bias.

    ``l1`` holds for 500 rows or more and is less in proportion for fewer.
    """
    l1 = l1 * min(1.0, len(y) / 500)
    epochs = max(epochs, min(40, 20_000 // max(len(y), 1)))
    z, n, w = (np.zeros(BUCKETS + 1) for _ in range(3))
    seen = np.bincount(np.concatenate([np.zeros(0, np.int64), *lists]), minlength=BUCKETS) >= MIN_ROWS
    lists = [r[seen[r]] for r in lists]
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            rows = [lists[i] for i in batch]
            sizes = [len(r) for r in rows]
            flat = np.concatenate([*rows, np.full(len(batch), BUCKETS)])
            owner = np.concatenate([np.repeat(np.arange(len(batch)), sizes), np.arange(len(batch))])
            p = _sigmoid(np.bincount(owner, weights=w[flat], minlength=len(batch)))
            error = (p - y[batch]) * weight[batch]
            ids, at = np.unique(flat, return_inverse=True)
            g = np.bincount(at, weights=error[owner])
            grown = np.sqrt(n[ids] + g * g)
            z[ids] += g - (grown - np.sqrt(n[ids])) / rate * w[ids]
            n[ids] = grown * grown
            shrunk = np.sign(z[ids]) * np.maximum(np.abs(z[ids]) - l1 * (ids != BUCKETS), 0)
            w[ids] = -shrunk / ((1 + grown) / rate + l2)
    return w


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        g = x.T @ ((p - y) * weight) + penalty * w
        h = (x * (p * (1 - p) * weight)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _dense_scores(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def co_train(words: list[np.ndarray], meta: np.ndarray, y: np.ndarray, pool_words: list[np.ndarray], pool_meta: np.ndarray) -> dict:
    """Both views' weights, and a calibrated combination of their scores, for one target."""
    held = np.arange(len(y)) % HELD_OUT == 0
    own = np.flatnonzero(~held)
    sets = [(np.zeros(0, int), np.zeros(0)) for _ in range(2)]  # pseudo-labelled rows of either view
    centre, spread = meta[own].mean(axis=0), meta[own].std(axis=0) + 1e-6
    meta, pool_meta = (meta - centre) / spread, (pool_meta - centre) / spread
    for round_ in range(ROUNDS + 1):
        scores, pool_scores = [], []
        for k, (rows, guess) in enumerate(sets):
            target = np.concatenate([y[own], guess])
            weight = np.concatenate([np.ones(len(own)), np.full(len(rows), PSEUDO_WEIGHT)])
            if k == 0:
                w_words = fit_words([words[i] for i in own] + [pool_words[i] for i in rows], target, weight)
                raw, pool_raw = Sparse(words).scores(w_words), Sparse(pool_words).scores(w_words)
            else:
                w_meta = fit_dense(np.vstack([meta[own], pool_meta[rows]]), target, weight)
                raw, pool_raw = _dense_scores(meta, w_meta), _dense_scores(pool_meta, w_meta)
            scale = fit_dense(raw[held, None], y[held], np.ones(held.sum()), ridge=1e-3)
            scores.append(raw[held] * scale[0] + scale[1])
            pool_scores.append(_sigmoid(pool_raw * scale[0] + scale[1]))
            if k == 0:
                cal_words = scale
            else:
                cal_meta = scale
        if round_ < ROUNDS:  # each view's sure rows go to the other
            for k, p in enumerate(pool_scores):
                sure = np.flatnonzero((p > SURE) | (p < 1 - SURE))
                sets[1 - k] = (sure, (p[sure] > 0.5).astype(float))
    both = fit_dense(np.stack(scores, axis=1), y[held], np.ones(held.sum()), ridge=1.0)
    return {"words": w_words, "meta": w_meta, "centre": centre, "spread": spread, "cal_words": cal_words, "cal_meta": cal_meta, "both": both}


def probability(model: dict, word_sums: np.ndarray, meta: np.ndarray) -> np.ndarray:
    a = (word_sums + model["words"][-1]) * model["cal_words"][0] + model["cal_words"][1]
    b = _dense_scores((meta - model["centre"]) / model["spread"], model["meta"]) * model["cal_meta"][0] + model["cal_meta"][1]
    return _sigmoid(a * model["both"][0] + b * model["both"][1] + model["both"][2])


# --- Spark


def _side_columns(docs: DataFrame) -> list:
    """Language and source as text, null where there is no such column."""
    have = {c.lower() for c in docs.columns}
    return [(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]


def _viewer():
    @F.arrow_udf("struct<ids:array<int>,meta:array<double>>")
    def view(texts: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Array:
        ids, meta = [], []
        for n, numbers, row, other in views(texts, lang, source):
            cuts = np.searchsorted(row, np.arange(n + 1))
            ids += [numbers[a:b].astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            meta += list(other)
        kinds = [pa.list_(pa.int32()), pa.list_(pa.float64())]
        return pa.StructArray.from_arrays([pa.array(ids, kinds[0]), pa.array(meta, kinds[1])], names=["ids", "meta"])

    return view


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> dict:
    """Models of the targets from ``labels`` (doc_id, quality, toxic), at most so many rows of either sample.

    Samples are the rows of least id hash.  A target whose sample lacks either class gets no model.
    Labels that are null are not used; of several labels for a document each counts.
    """
    sure = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    known = sure.select("doc_id", (1 - F.col("quality")).cast("int").alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))
    known = known.withColumn("r", F.xxhash64("doc_id")).orderBy("r", "doc_id").limit(labelled)
    others_ = docs.select("doc_id").where("doc_id IS NOT NULL").withColumn("r", F.xxhash64(F.lit(1), F.col("doc_id"))).orderBy("r", "doc_id").limit(pool)
    asked = known.unionByName(others_.select("doc_id", F.lit(None).cast("int").alias("low_quality"), F.lit(None).cast("int").alias("toxic"), "r"))
    # both samples are bounded by parameters: a few hundred KB
    rows = docs.select("doc_id", "text", *_side_columns(docs)).join(F.broadcast(asked), "doc_id")
    rows = rows.select("doc_id", "r", *TARGETS, _viewer()(F.col("text"), F.col("lang"), F.col("source")).alias("v")).toArrow()
    rows = rows.sort_by([("r", "ascending"), ("doc_id", "ascending")])
    ids = [np.asarray(x.values) for x in rows["v"].combine_chunks().field("ids")]
    meta = np.array(rows["v"].combine_chunks().field("meta").to_pylist()).reshape(-1, N_META)
    has = ~np.isnan(rows[TARGETS[0]].to_numpy().astype(float))
    named = set(rows["doc_id"].filter(pa.array(has)).to_pylist())
    free = np.array([not h and d not in named for h, d in zip(has, rows["doc_id"].to_pylist(), strict=True)], bool)
    mine, pooled = np.flatnonzero(has), np.flatnonzero(free)
    models = {}
    for target in TARGETS:
        y = rows[target].to_numpy().astype(float)[mine]
        held = np.arange(len(y)) % HELD_OUT == 0
        if len(y) and all(len(set(part.tolist())) == 2 for part in (y[held], y[~held])):
            models[target] = co_train([ids[i] for i in mine], meta[mine], y, [ids[i] for i in pooled], meta[pooled])
    return models


OWN = ["p_low_quality", "p_toxic", "score", "kept"]


def score_quality(docs: DataFrame, models: dict, reject: float = REJECT) -> DataFrame:
    """``docs`` with p_low_quality, p_toxic, score and kept; columns of these names are replaced.

    score is the probability of neither fault; a row is kept if both probabilities are at most
    ``reject``.  A target without a model has probability 0.  Null and empty texts are scored by
    their (empty) features, a null language or source is a value of its own.  Rows are scored alone, so
    repeated rows agree and an empty table gives an empty result.
    """
    lean = {t: {k: (v.astype(np.float32) if k == "words" else v) for k, v in m.items()} for t, m in models.items()}
    shared = docs.sparkSession.sparkContext.broadcast(lean)  # about 1 MB a target, by BUCKETS

    @F.arrow_udf("struct<p_low_quality:double,p_toxic:double>")
    def score(texts: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Array:
        out = {t: [np.zeros(0)] for t in TARGETS}
        for n, ids, row, meta in views(texts, lang, source):
            for t in TARGETS:
                model = shared.value.get(t)
                if model is None:
                    out[t].append(np.zeros(n))
                else:
                    out[t].append(probability(model, np.bincount(row, weights=model["words"][ids], minlength=n), meta))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(out[t])) for t in TARGETS], names=[f"p_{t}" for t in TARGETS])

    rest = others(docs, [*OWN, "_p"])
    lang, source = _side_columns(docs)
    found = docs.withColumn("_p", score(F.col("text"), lang, source)).select(*rest, "_p.*")
    kept = (F.col("p_low_quality") <= reject) & (F.col("p_toxic") <= reject)
    return found.withColumn("score", (1 - F.col("p_low_quality")) * (1 - F.col("p_toxic"))).withColumn("kept", kept)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier trained on ``labels`` keeps; all columns stay."""
    scored = score_quality(docs, train(docs, labels))
    return scored.where("kept").drop(*OWN)


def op2_quality(spark, sf_dir):
    """All documents scored by classifiers co-trained on the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", *OWN)
