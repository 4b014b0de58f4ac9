"""Mixing, vectors, license scans, the classifier, and the pipeline."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagemill.llm import licenses, mixing, quality, registry, tables, vectors


def test_targets(spark):
    rows = [("b", 100), ("a", 1000), (None, 10), ("é", 50), ("b", 300), ("z", 0)]
    found = {r.source: r for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    # weights by code point, nulls last: a 3, b 1, z 2, é 3, null 1
    assert [found[s].source_size for s in ("a", "b", "z", "é", None)] == [1000, 400, 0, 50, 10]
    sizes, weights = np.array([1000, 400, 0, 50, 10.0]), np.array([3, 1, 2, 3, 1.0])
    target, left, free = np.zeros(5), 1.5 * sizes.sum(), np.ones(5, bool)
    while free.any() and left > 1e-9:
        target[free] += left * weights[free] / weights[free].sum()
        over = target > 2 * sizes
        left, target[over] = (target - 2 * sizes)[over].sum(), 2 * sizes[over]
        free &= ~over
    assert np.allclose([found[s].target for s in ("a", "b", "z", "é", None)], target)


@pytest.mark.parametrize("chunk", [7, 50_000])
def test_mix(spark, chunk):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([0, 1, 5, 40, 300])) for i in range(900)] + [(5, "a", 7)] * 3 + [(None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    mixed = mixing.mix(docs, chunk_rows=chunk, fan=3).collect()
    assert Counter((r.doc_id, r.source) for r in mixed) == Counter((i, s) for i, s, _ in rows)
    taken, target = Counter(), {}
    for r in mixed:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) < 300 for s in target)
    again = mixing.mix(docs.repartition(5), chunk_rows=chunk, fan=3).collect()
    assert sorted(map(repr, ((r.doc_id, r.size, r.copies) for r in mixed))) == sorted(map(repr, ((r.doc_id, r.size, r.copies) for r in again)))


def test_meeting_is_fair():
    rng = np.random.default_rng(0)
    for p, s, q, t in [(0.3, 5, 0.6, 9), (0.9, 100, 0.2, 3), (0.5, 1, 0.5, 1)]:
        ends = np.array([mixing.meet(p, s, q, t, u) for u in rng.random(20_000)])
        assert np.allclose(ends @ [s, t], p * s + q * t) and np.allclose(ends.mean(axis=0), [p, q], atol=0.02)
        assert (np.isin(ends, [0, 1]).any(axis=1) & (ends >= 0).all(axis=1) & (ends <= 1).all(axis=1)).all()


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id bigint, source string, size bigint")).count() == 0


@pytest.mark.parametrize("block", [16, 4096])
def test_vectors(spark, block):
    rng = np.random.default_rng(3)
    hearts = rng.normal(size=(10, 12))
    x = [(hearts[rng.integers(10)] + rng.normal(size=12) * rng.choice([0.05, 0.12, 0.5])).astype(np.float32).tolist() for _ in range(250)]
    x += [x[0]] * 40 + [(np.array(x[1]) * 3).tolist()]
    odd = [None, [], [0.0] * 12, [float("nan")] * 12, [None] + [1.0] * 11, [float("inf")] * 12, [1.0] * 5]
    rows = [(i, v) for i, v in enumerate(x + odd)] + [(None, x[2]), (7, x[7])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    good = [k for k, (_, v) in enumerate(rows) if v and len(v) == 12 and None not in v and np.isfinite(v).all() and any(v)]
    m = np.array([rows[k][1] for k in good], np.float32).astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    from pagemill.llm.tokens import min_labels

    order = [(1 << 62) if rows[k][0] is None else rows[k][0] for k in good]
    label = min_labels(len(good), *np.nonzero(near))
    least = defaultdict(lambda: 1 << 62)
    for o, c in zip(order, label):
        least[c] = min(least[c], o)
    expected = [(i, 0, i) for k, (i, _) in enumerate(rows) if k not in good]
    expected += [(rows[k][0], int(near[j].sum()) - 1, least[label[j]]) for j, k in enumerate(good)]
    found = [(r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(table, 0.95, block).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
    assert sum(e[1] for e in expected) > 1000
    assert vectors.near_vectors(table.limit(0), 0.95).count() == 0


def test_licenses(docs, corpus, no_docs, clashing, spark):
    texts = ["CC-BY and cc  by", "the General Public Licence, all rights\nreserved", "generl publik license", None, "", "cc byx accby", "All Rights Reserved all rights reserved",
             "Permission is hereby granted, free of charges", "nothing to see"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in licenses.scan_licenses(rows).collect()}
    assert (found[0].n_base, found[0].first_word, found[0].last_word, found[0].base_labels, found[0].score) == (2, 0, 3, "cc-by", 1.0)
    assert (found[1].n_base, found[1].base_labels, found[1].labels) == (1, "reserved", "gpl,reserved")
    assert (found[2].n_base, found[2].labels, found[2].first_word) == (0, "gpl", None) and 0 < found[2].score < 1
    assert [(s.label, s.start, s.end, s.edits) for s in found[2].spans] == [("gpl", 0, 3, 2)]
    assert (found[3].n_words, found[3].labels, found[3].score) == (0, "", 0.0) == (found[4].n_words, found[4].labels, found[4].score)
    assert found[5].n_base == 0 and (found[6].n_base, found[6].first_word, found[6].last_word) == (2, 0, 3)
    assert found[7].labels == "mit" and found[8].labels == ""
    assert licenses.scan_licenses(clashing).count() == len(corpus) and licenses.scan_licenses(no_docs).count() == 0


def test_seeds_reach_every_edited_notice():
    """Within its edits every notice is found, whatever the edits."""
    rng = random.Random(9)
    patterns = licenses.compiled()
    for notice, label, k, _ in patterns:
        for _ in range(40):
            s = list(notice)
            for _ in range(rng.randint(0, k)):
                at = rng.randrange(len(s))
                kind = rng.randrange(3)
                if kind == 0:
                    s[at] = rng.choice("xyz")
                elif kind == 1:
                    del s[at]
                else:
                    s.insert(at, rng.choice("xyz"))
            assert label in licenses.scan_text(("before " + "".join(s) + " after").encode(), patterns)["labels"].split(",")


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        junk, toxic = rng.random() < 0.2, rng.random() < 0.2
        if junk:
            words = [w + rng.choice(["%%%", "$$$", "###"]) for w in words]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilewort", "vileness", "vilest"])
        rows.append((i, " ".join(words), "en", f"s{i % 5}", int(junk), int(toxic)))
        if i % 2:
            labels.append((i, 1 - int(junk), int(toxic)))
    labels += [(None, 1, 0), (3, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, junk int, toxic int")
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_on_rows_held_out(graded):
    docs, labels = graded
    scored = quality.score_quality(docs, quality.train(docs, labels)).where("doc_id % 2 = 0").toPandas()
    assert ((scored.p_low_quality > 0.5) == (scored.junk == 1)).mean() > 0.98
    assert ((scored.p_toxic > 0.5) == (scored.toxic == 1)).mean() > 0.97
    assert (scored[(scored.junk == 0) & (scored.toxic == 0)].kept).mean() > 0.98


def test_quality_odd_rows(graded, docs, corpus, clashing, no_docs):
    some, labels = graded
    models = quality.train(some, labels)
    assert quality.score_quality(clashing, models).where("score is not null and kept is not null").count() == len(corpus)
    assert quality.score_quality(no_docs, models).count() == 0
    assert quality.train(some, labels.limit(0)) == {}
    assert quality.accepted(docs, labels.limit(0)).count() == len(corpus)


def test_pipeline_on_test_data(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
    sf = "/root/testdata/sf0.001"
    docs = tables.table(spark, sf, "documents")
    columns, before = docs.columns, {(r.doc_id, r.text) for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = tables.store(stage(spark, docs, sf), "test")
        assert docs.columns[: len(columns)] == columns
        now = {(r.doc_id, r.text) for r in docs.collect()}
        assert now <= before and now
        before = now
    words = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [words.findall(r.text.encode().lower()) for r in tables.table(spark, sf, "benchmark").collect()]
    grams = {tuple(w[p : p + 10]) for w in items for p in range(len(w) - 9)}
    for _, text in before:
        w = words.findall(text.encode().lower())
        assert not any(tuple(w[p : p + 10]) in grams for p in range(len(w) - 9))


def test_empty_stages(spark, no_docs):
    import corpus_pipeline

    empty = no_docs.selectExpr("*", "cast(null as bigint) n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_registry():
    names = [f"op{n}_" for n in range(1, 11)]
    assert all(sum(q.startswith(n) for q in registry.QUERIES) == 1 for n in names) and "pipeline" in registry.QUERIES
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def test_every_notice_of_a_window_is_found():
    """Edited notices before the best one of a stretch are found as well."""
    patterns = [p for p in licenses.compiled() if p[0] == "all rights reserved"]
    found = licenses.scan_text(b"al rights reserved all right reserved all rights reserved all rghts reserved", patterns)
    assert [(s["start"], s["end"], s["edits"]) for s in found["spans"]] == [(0, 3, 1), (3, 6, 1), (6, 9, 0), (9, 12, 1)]
    assert found["n_base"] == 1 and found["labels"] == "reserved"


def test_many_notices_in_one_text():
    """The time of a scan is linear in the notices of a text."""
    start = time.time()
    found = licenses.scan_text(b"all rights reserved generl public licens " * 50_000, licenses.compiled())
    assert found["n_base"] == 50_000 and found["n_words"] == 300_000
    assert Counter((s["label"], s["edits"]) for s in found["spans"]) == {("reserved", 0): 50_000, ("gpl", 2): 50_000}
    assert time.time() - start < 30
