"""Operators whose results are exact, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from pagemill.llm import components, decontaminate, lines, sharding, simhash, substrings, suffixes, tokens

LAST = (1 << 63) - 1


def key(i):
    return LAST if i is None else i


def order(rows):
    return sorted(rows, key=repr)


def test_lines(docs, corpus, no_docs, clashing):
    blank = " \t\n\x0b\x0c\r"
    split = [(i, (t or "").split("\n")) for i, t, *_ in corpus]
    fold = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(blank))
    seen = defaultdict(set)
    for (i, ls), (_, t, *_) in zip(split, corpus):
        for x in ls:
            seen[fold(x)].add((i, t))
    expected = []
    for i, ls in split:
        kept = [x for x in ls if not (fold(x) and len(seen[fold(x)]) >= 10)]
        expected.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    for table in (docs, clashing):
        found = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in lines.line_dedup(table, 10, "none").collect()]
        assert order(found) == order(expected)
    assert any(e[2] for e in expected)
    assert lines.line_dedup(no_docs, 10, "none").count() == 0


def test_first_line_stays(docs, corpus):
    found = {r.doc_id: r for r in lines.line_dedup(docs, 2, "first").where("doc_id between 66 and 78").collect()}
    # of the key in several documents the first line stays; others are in one document only
    assert found[66].kept_text == "The line\nshared\nThe line\n" + "x\n" * 5
    assert [(r.start, r.length) for r in found[66].drop_runs] == [(3, 1)]
    assert found[70].kept_text == "own 3"


def test_shards(docs, corpus, no_docs, clashing):
    placed = sharding.shard(docs, 8, bucket_bytes=20_000).collect()
    assert Counter((r.doc_id, r.text) for r in placed) == Counter((i, t) for i, t, *_ in corpus)
    slots = defaultdict(list)
    for r in placed:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard(docs.repartition(5), 8, bucket_bytes=20_000).collect()
    assert order((r.doc_id, r.text, r.shard, r.slot) for r in placed) == order((r.doc_id, r.text, r.shard, r.slot) for r in again)
    wide = sharding.shard(clashing, 8)
    assert [c for c in wide.columns if c in ("shard", "slot")] == ["shard", "slot"] and wide.count() == len(corpus)
    assert sharding.shard(no_docs, 8).count() == 0
    assert zlib.crc32(b"abc") == 891568578


def test_shards_of_one_row_repeated(spark):
    many = spark.createDataFrame([(1, "same text")] * 3000 + [(None, None)] * 1000, "doc_id bigint, text string")
    placed = sharding.shard(many, 8, bucket_bytes=10_000)
    assert sorted(r["count"] for r in placed.groupBy("shard").count().collect()) == [500] * 8


def brute_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + width]), 42) for k in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, near):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(n):
        for b in range(a):
            if near(a, b):
                label[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(n)]


def test_simhash(docs, corpus, no_docs, clashing):
    fps = [brute_fingerprint(t, 4) for _, t, *_ in corpus]
    root = classes(len(corpus), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    least = defaultdict(lambda: LAST)
    for (i, *_), r in zip(corpus, root):
        least[r] = min(least[r], key(i))
    expected = [(i, f, None if least[r] == LAST else least[r]) for (i, *_), f, r in zip(corpus, fps, root)]
    for table in (docs, clashing):
        found = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(table, 4, 4).collect()]
        assert order(found) == order(expected)
    assert simhash.near_duplicates(no_docs, 4, 4).count() == 0


@pytest.mark.parametrize("distance", [2, 5, 8])
@pytest.mark.parametrize("block", [16, 4096])
def test_near_fingerprints_lose_no_link(spark, distance, block):
    rng = np.random.default_rng(distance)
    heart = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce([np.uint64(1) << np.uint64(b) for b in rng.integers(0, 64, rng.integers(1, 6))]) for _ in range(600)]
    fps = np.unique(np.concatenate([heart[rng.integers(0, 12, 600)] ^ np.array(flips), rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance)
    expected = tokens.min_labels(len(fps), x, y)
    table = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    links = simhash.near_fingerprints(table, distance, block)
    at = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    found = [(at[r.a], at[r.b]) for r in links.collect()]
    assert all((fps[a] ^ fps[b]) or a == b for a, b in found)
    got = tokens.min_labels(len(fps), np.array([a for a, _ in found], int), np.array([b for _, b in found], int))
    assert (got == expected).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 160)] + [(7, 7)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{j: 100 for j in range(101, 160)}}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicate_stage(docs, corpus, no_docs, clashing):
    """The first document of each class stays, once."""
    fps = [brute_fingerprint(t, 4) for _, t, *_ in corpus]
    root = classes(len(corpus), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    members = defaultdict(list)
    for (i, t, *_), r in zip(corpus, root):
        members[r].append((key(i), t))
    kept = simhash.without_near_duplicates(docs, 4, 4).collect()
    assert sorted(key(r.doc_id) for r in kept) == sorted(min(i for i, _ in m) for m in members.values())
    assert {(key(r.doc_id), r.text) for r in kept} <= {x for m in members.values() for x in m}
    assert simhash.without_near_duplicates(clashing, 4, 4).columns == [c for c in clashing.columns if c not in ("_id", "_th")]
    assert simhash.without_near_duplicates(no_docs, 4, 4).count() == 0


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination(spark, docs, corpus, no_docs, clashing):
    long = next(t for i, t, *_ in corpus if i == 64).split()
    items = [(1, " ".join(long[100:150])), (20, " ".join(corpus[30][1].split()[:12]).upper()), (3, "one TWO"), (None, " ".join(long[140:160])), (4, None), (5, "?!")]
    items += [(6, " ".join(long[500:509] + ["nowhere"] + long[510:530]))]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    words = lambda t: WORD.findall((t or "").encode().lower())
    expected = []
    for i, t, *_ in corpus:
        w, hit, names = words(t), set(), set()
        for name, text in items:
            v = words(text)
            n = min(10, len(v))
            grams = {tuple(v[p : p + n]) for p in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1) if n else ():
                if tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    names.add("null" if name is None else str(name))
        expected.append((i, len(w), len(hit), sorted(names)))
    for size in (8 << 20, 100):  # all items at once, and block by block
        for source in (docs, clashing):
            found = decontaminate.match_benchmark(source, table, 10, size).collect()
            assert order((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found) == order(expected)
            assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in found)
    longest = next(r for r in found if r.doc_id == 64)
    assert longest.longest == 50 and longest.longest_at == 100 and longest.longest_item == "1"
    assert decontaminate.match_benchmark(no_docs, table).count() == 0
    assert decontaminate.match_benchmark(docs, table.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs, table).count() == sum(not e[2] for e in expected)


def test_substrings(docs, corpus, no_docs, clashing):
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))
    words = [(i, (t or "").encode().split()) for i, t, *_ in corpus]
    low = {}
    for i, w in words:
        for p in range(len(w) - 49):
            g = tuple(w[p : p + 50])
            low[g] = min(low.get(g, LAST), key(i))
    expected = []
    for i, w in words:
        gone = {q for p in range(len(w) - 49) if low[tuple(w[p : p + 50])] < key(i) for q in range(p, p + 50)}
        expected.append((i, len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode()))
    for table in (docs, clashing):
        found = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.substring_dedup(table).collect()]
        assert order(found) == order(expected)
    assert sum(e[2] for e in expected) > 3000
    assert substrings.substring_dedup(no_docs).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for _ in range(60):
        text = rng.integers(0, letters, rng.integers(1, 80)).astype(np.uint8)
        array = suffixes.suffix_array(text)
        assert array.tolist() == sorted(range(len(text)), key=lambda i: bytes(text[i:]))
        shared = suffixes.common_prefixes(array, suffixes.eight_bytes(text), 20)
        for k in range(1, len(text)):
            a, b = bytes(text[array[k - 1] :]), bytes(text[array[k] :])
            n = next((q for q in range(min(len(a), len(b))) if a[q] != b[q]), min(len(a), len(b)))
            assert shared[k] >= min(n, 20) and (letters < 3 or 0 in text or shared[k] == min(n, 20))


@pytest.mark.parametrize("hot", [16_384, 2])
def test_suffix_dedup(docs, corpus, no_docs, clashing, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_CONTENTS", hot)
    th = {(r.doc_id, r.text): r.th for r in docs.selectExpr("doc_id", "text", "xxhash64(text) th").collect()}
    rows = sorted({(key(i), th[i, t], i, t) for i, t, *_ in corpus}, key=lambda r: r[:2])
    seen, result = set(), {}
    for _, _, i, t in rows:
        b, gone = (t or "").encode(), set()
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone.update(range(p, p + 100))
            seen.add(w)
        spans = sum(q - 1 not in gone for q in gone)
        result[i, t] = (i, len(b), len(gone), spans, hashlib.sha256(bytes(x for q, x in enumerate(b) if q not in gone)).hexdigest())
    expected = [result[i, t] for i, t, *_ in corpus]
    for table in (docs, clashing):
        found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixes.suffix_dedup(table).collect()]
        assert order(found) == order(expected)
    assert sum(e[2] for e in expected) > 5000
    assert suffixes.suffix_dedup(no_docs).count() == 0
