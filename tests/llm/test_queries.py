"""The queries themselves on small tables, against brute force written from what they promise to return."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from pagemill.llm import registry
from pagemill.llm.tables import table

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows(corpus):
    """The corpus with ids that are all different and present, and passages of the benchmark and of licenses."""
    rng = random.Random(3)
    kept = [(i, text, lang, source) for i, (_, text, lang, source) in enumerate(corpus)]
    texts = [
        "before CC-BY after. All  rights\nReserved and general public licence, General Public License",
        "x " + " ".join(f"word{i}" for i in range(12)) + " y " + " ".join(f"word{i}" for i in range(12)),
        "short item", "Short ITEM, and more", "é" * 300, ("abcdefghij" * 30 + "\n") * 3, "tail " + "abcdefghij" * 30,
        " ".join(rng.choice("abc") for _ in range(900)), "the line\n\n\tTHE LINE \x0b\n" * 4,
    ]
    return kept + [(1000 + i, t, "en", "z") for i, t in enumerate(texts)]


BENCHMARK = [(1, "Word0 word1, word2 word3 word4 word5 word6 word7 word8 word9 word10"), (2, "short item"), (3, ""), (4, None), (10, "absent words only in this item of the benchmark list here")]


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(r[0], int(r[0] % 3 > 0), int(r[0] % 5 == 0)) for r in rows[::2]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def run(spark, sf, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, sf).collect()]


def raw(text):
    return (text or "").encode()


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, sf, rows):
    found = run(spark, sf, "op1_shard")
    want = Counter((i, len(raw(t)) + 1, zlib.crc32(raw(t)), "rows", None) for i, t, _, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in found) == want
    shards = defaultdict(list)
    for r in found:
        shards[r["shard"]].append(r["slot"])
    assert set(shards) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_op2(spark, sf, rows):
    found = run(spark, sf, "op2_quality")
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    for r in found:
        assert 0 <= r["p_low_quality"] <= 1 and 0 <= r["p_toxic"] <= 1
        assert r["score"] == pytest.approx((1 - r["p_low_quality"]) * (1 - r["p_toxic"]))
        assert r["kept"] == (r["p_low_quality"] <= 0.5 and r["p_toxic"] <= 0.5)


def components(ids, near):
    label = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_op3(spark, sf, rows):
    def fingerprint(text):
        words = BLANK.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw(text)))
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t, _, _ in rows}
    ids = list(prints)
    near = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    label = components(ids, near)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in run(spark, sf, "op3_simhash")} == {(i, f"{prints[i]:016x}", label[i]) for i in ids}


def test_op4(spark, sf, rows):
    def words(text):
        return ALNUM.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw(text)))

    windows = defaultdict(set)
    for item, text in BENCHMARK:
        w = words(text)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(str(item))
    for r, (_, text, _, _) in zip(sorted(run(spark, sf, "op4_decontaminate"), key=lambda r: r["doc_id"]), rows, strict=True):
        w, hit, items = words(text), set(), set()
        for window, names in windows.items():
            for p in range(len(w) - len(window) + 1):
                if tuple(w[p : p + len(window)]) == window:
                    hit |= set(range(p, p + len(window)))
                    items |= names
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(items), bool(hit))
        assert r["items_sha256"] == digest(",".join(sorted(items)).encode())


def test_op5(spark, sf, rows):
    found = run(spark, sf, "op5_mix_sources")
    sizes = {i: len(BLANK.findall(raw(t))) for i, t, _, _ in rows}
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter(sizes.items())
    of = {i: s for i, _, _, s in rows}
    totals = Counter()
    for i, n in sizes.items():
        totals[of[i]] += n
    sources = sorted((s for s in totals if s is not None), key=lambda s: s) + ([None] if None in totals else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, free, left = dict.fromkeys(sources, 0.0), set(sources), 1.5 * sum(sizes.values())
    while free and left > 1e-9:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += share * weight[s]
            if target[s] > 2 * totals[s]:
                left += target[s] - 2 * totals[s]
                target[s] = 2.0 * totals[s]
                free.discard(s)
    taken = Counter()
    for r in found:
        assert r["source_size"] == totals[of[r["doc_id"]]] and r["target"] == pytest.approx(target[of[r["doc_id"]]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[of[r["doc_id"]]] += r["taken"]
    for s in sources:
        assert abs(taken[s] - target[s]) <= max(n for i, n in sizes.items() if of[i] == s)


def test_op7(spark, sf, rows):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for r, (_, text, _, _) in zip(sorted(run(spark, sf, "op7_license_scan"), key=lambda r: r["doc_id"]), rows, strict=True):
        w = [x.decode() for x in ALNUM.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw(text)))]
        places = [(p, label) for phrase, label in phrases.items() for p in range(len(w)) if tuple(w[p : p + len(phrase)]) == phrase]
        starts, labels = [p for p, _ in places], sorted({label for _, label in places})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(labels))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert set(labels) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_op8(spark, sf, rows):
    firsts = {}
    texts = {i: BLANK.findall(raw(t)) for i, t, _, _ in rows}
    for i in sorted(texts):
        for p in range(len(texts[i]) - 49):
            firsts.setdefault(tuple(texts[i][p : p + 50]), i)
    want = set()
    for i, w in texts.items():
        gone = {k for p in range(len(w) - 49) if firsts[tuple(w[p : p + 50])] < i for k in range(p, p + 50)}
        want.add((i, len(w), len(gone), digest(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert {tuple(r.values()) for r in run(spark, sf, "op8_substring_dedup")} == want
    assert any(x[2] for x in want)


def test_op9(spark, sf, rows):
    strip = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")

    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), strip.sub("", line))

    seen = defaultdict(set)
    for i, t, _, _ in rows:
        for line in (t or "").split("\n"):
            seen[key(line)].add(i)
    want = set()
    for i, t, _, _ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not key(x) or len(seen[key(x)]) < 10]
        want.add((i, len(lines), len(lines) - len(stay), digest("\n".join(stay).encode())))
    assert {tuple(r.values()) for r in run(spark, sf, "op9_line_dedup")} == want
    assert any(x[2] for x in want)


def test_op10(spark, sf, rows):
    seen, want = set(), set()
    for i, t, _, _ in sorted(rows, key=lambda r: r[0]):
        data = raw(t)
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            part = data[p : p + 100]
            if part in seen:
                gone[p : p + 100] = b"\x01" * 100
            seen.add(part)
        runs = len(re.findall(b"\x01+", bytes(gone)))
        want.add((i, len(data), sum(gone), runs, digest(bytes(b for b, g in zip(data, gone, strict=True) if not g))))
    assert {tuple(r.values()) for r in run(spark, sf, "op10_suffix_dedup")} == want
    assert sum(x[3] for x in want) > 20


OWN = ["size", "target", "source_size", "copies", "_r", "_chunk", "_p", "_copy", "score", "kept", "p_toxic", "_v", "n_words", "spans", "longest", "_found", "_id", "_th", "n", "fp", "_bucket", "_at", "_row", "_start"]


def test_stages_keep_the_columns_of_users(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents").selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in OWN])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns + (["shard", "slot"] if k == 4 else []), name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in OWN), name
    own = docs.selectExpr("*", "'mine' AS shard", "'mine' AS slot")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert {(r.shard, r.slot) for r in stage(spark, own, sf).collect()} == {("mine", "mine")}, name
