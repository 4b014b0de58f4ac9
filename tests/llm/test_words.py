"""Spelling variants and collocations against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pagemill.llm import collocations, spelling

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def typos():
    """Rows (doc_id, text) of words that resemble each other, with repeats, nulls and a long text."""
    rng = random.Random(7)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "bananaé", "Straße", "naïveté"]

    def word():
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abé") + w[i + 1 :]])
        return rng.choice([w, w.upper() if w.isascii() else w, w.capitalize() if w[0].isascii() else w])

    rows = [(i, " ".join(word() + rng.choice(["", ".", "7", "-"]) for _ in range(60))) for i in range(120)]
    rows += [(1, rows[0][1]), (1, rows[0][1]), (None, rows[3][1]), (200, None), (201, ""), (202, "÷×÷×÷×÷ Ÿÿÿÿÿÿÿ \n")]
    return rows + [(203, " ".join(word() for _ in range(8000)))]


def counted(rows, min_chars, min_count, typo_every):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typo_every and h % typo_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_chars:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= min_count}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else len(a) == len(b) + 1 and a[k + 1 :] == b[k:])


def variants(words, ratio):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: b if b and words[b] >= ratio * words[w] else None for w, b in best.items()}
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


@pytest.mark.parametrize(("min_chars", "ratio", "at_most"), [(6, 5, 50_000), (6, 2, 10), (3, 3, 1)])
def test_spelling_variants(spark, typos, min_chars, ratio, at_most):
    docs = spark.createDataFrame(typos, "doc_id bigint, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS form")
    found = spelling.spelling_variants(docs, min_chars, 3, ratio, typo_every=7, at_most=at_most)
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()]
    expected = variants(counted(typos, min_chars, 3, 7), ratio)
    assert len(got) == len(set(got)) and set(got) == expected
    assert any(f and r != f for _, f, r, *_ in expected)  # chains occur


def test_grams_cover_edits():
    """The grams that an edit leaves are at least as many as the bound says, in both words."""
    rng = random.Random(3)
    frequent = {"ab": 9, "ba": 9, "aba": 5, "abab": 4, "aa": 7, "aaa": 3, "a$": 2}
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(6, 12)))
        i = rng.randrange(len(a) + 1)
        b = rng.choice([a[:i] + "a" + a[i:], a[:i] + a[i + 1 :], a[:i] + "b" + a[i + 1 :]])
        (x, n, _), (y, m, _) = spelling.probes(a, frequent, 5), spelling.probes(b, frequent, 5)
        assert len(set(x) & set(y)) >= max(n, m) and (len(b) < 6 or min(n, m) > 0)
        assert spelling.decomposed(a, frequent, 5)[0] == [g for g in spelling.decomposed(a, frequent, 5)[0] if g in a + "$"]


def test_spelling_of_nothing(spark, no_docs):
    assert spelling.spelling_variants(no_docs).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(no_docs, min_chars=2).count()


def test_spelling_query(spark, corpus, corpus_dir):
    got = {tuple(r) for r in spelling.op11_spelling_variants(spark, corpus_dir).collect()}
    assert got == variants(counted([(r[0], r[1]) for r in corpus], 6, 5, 199), 5)


def expected_collocations(rows, longest, min_count, top, share):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    found = defaultdict(list)
    candidates = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= min_count}
    inside = defaultdict(int)
    for (lang, words), c in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                inside[lang, words[i : i + m]] = max(inside[lang, words[i : i + m]], c)
    for (lang, words), a in candidates.items():
        if 100 * inside[lang, words] >= share * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, rows in found.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)
    }


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = ["one", "Two", "three", "été", "x\x00y", " ", "a'b", "$", "ONE"]
    fixed = ["one two three été one two", "New York City", "New York City Hall"]
    rows = []
    for i in range(150):
        text = "".join(rng.choice([rng.choice(words), rng.choice(words), rng.choice(fixed)]) + rng.choice([" ", " ", "\t ", ", ", ".", "\n", "\r\n"]) for _ in range(60))
        rows.append((rng.choice(["en", "de", None, "und", ""]), text))
    return rows + [("en", None), ("en", ""), (None, " .\t, "), rows[0], rows[0], ("fr", "rare words only here")] + [("de", "de de " * 3000)]


@pytest.mark.parametrize(("longest", "min_count", "top", "share"), [(5, 10, 2000, 100), (3, 4, 7, 100), (5, 25, 50, 60), (2, 1, 2000, 100)])
def test_collocations(spark, prose, longest, min_count, top, share):
    docs = spark.createDataFrame(prose, "lang string, text string").selectExpr("*", "'x' AS w1", "1 AS n", "2 AS phrase").repartition(3)
    found = [tuple(r) for r in collocations.collocations(docs, longest, min_count, top, share).collect()]
    assert len(found) == len(set(found))
    assert set(found) == expected_collocations(prose, longest, min_count, top, share)


def test_large_products(spark):
    """Products beyond 64 bits: one pair of a great many words, by its counts alone."""
    rows = [(i, "big", 0, "", 4 * 10**15) for i in range(1)]
    counts = spark.createDataFrame(rows, "i int, lang string, m int, phrase string, f bigint").drop("i")
    more = [("big", 1, "a", 3 * 10**15), ("big", 1, "b", 2 * 10**15), ("big", 2, "a b", 10**15)]
    counts = counts.unionByName(spark.createDataFrame(more, "lang string, m int, phrase string, f bigint"))
    found = collocations.ranked(counts, 2000, 100).collect()
    assert [tuple(r) for r in found] == [("big", 1, "a b", 10**15, 3 * 10**15, 2 * 10**15, 4 * 10**15, 1000 * 10**15 * 4 * 10**15 // (6 * 10**30))]


def test_bitmap_size_is_bounded(spark, prose, monkeypatch):
    """With a bitmap too small to tell words apart the counts are the same."""
    monkeypatch.setattr(collocations, "LEAST_BITS", 15)
    monkeypatch.setattr(collocations, "MOST_BITS", 15)
    docs = spark.createDataFrame(prose, "lang string, text string")
    assert {tuple(r) for r in collocations.collocations(docs, 5, 10, 2000).collect()} == expected_collocations(prose, 5, 10, 2000, 100)


def test_collocations_of_nothing(spark, no_docs):
    assert collocations.collocations(no_docs).count() == 0


def test_collocation_query(spark, corpus, corpus_dir):
    got = {tuple(r) for r in collocations.op13_collocations(spark, corpus_dir).collect()}
    assert got == expected_collocations([(r[2], r[1]) for r in corpus], 5, 100, 2000, 100)
