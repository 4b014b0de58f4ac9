"""License scans: fuzzy search for short notices.

A notice within k edits leaves one of any k + 1 pieces of it intact.  These pieces are looked
for as exact seeds; around each seed the ``regex`` library verifies the notice with its bounded number
of edits and gives the span.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import others, table

# fixed values: phrases that count as such, with their labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# parameters: notices that are also found with edits; notice, label, most edits
NOTICES = [
    ("general public license", "gpl", 2),
    ("all rights reserved", "reserved", 2),
    ("creative commons attribution", "cc-by", 3),
    ("permission is hereby granted free of charge", "mit", 4),
    ("licensed under the apache license", "apache", 3),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("released into the public domain", "public-domain", 3),
    ("licensed under the mit license", "mit", 2),
    ("the software is provided as is without warranty of any kind", "mit", 4),
    ("this program is free software you can redistribute it and or modify it", "gpl", 5),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("apache license version", "apache", 2),
    ("neither the name of the copyright holder nor the names of its contributors", "bsd", 5),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 5),
    ("eclipse public license", "epl", 2),
    ("european union public licence", "eupl", 2),
    ("boost software license", "boost", 2),
    ("dedicated to the public domain", "public-domain", 3),
    ("creative commons zero", "cc0", 2),
    ("attribution sharealike", "cc-by-sa", 2),
    ("attribution noncommercial", "cc-by-nc", 2),
    ("attribution noderivs", "cc-by-nd", 2),
    ("gnu free documentation license", "gfdl", 3),
    ("open database license", "odbl", 2),
    ("sil open font license", "ofl", 2),
    ("reproduced with permission", "permission", 2),
    ("no part of this publication may be reproduced", "reserved", 4),
]

SCAN = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,spans:array<struct<label:string,start:bigint,end:bigint,edits:int>>>"
OWN = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
_KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def seeds(notice: str, edits: int) -> list[tuple[bytes, int]]:
    """``edits + 1`` pieces of the notice, each with its place."""
    n, k = len(notice), edits + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(notice[a:b].encode(), a) for a, b in zip(cuts, cuts[1:], strict=False)]


def fuzzy_spans(line: bytes, notice: str, edits: int, pattern) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the notice in ``line`` with at most so many edits; spans don't overlap.

    Around each seed lies one window, no wider than the notice and its edits, so the time is linear in the seeds.
    The best match of every window is looked for; closer matches take their place first.  A window that lost its
    match is searched again beside those.
    """
    windows = set()
    for seed, at in seeds(notice, edits):
        place = line.find(seed)
        while place >= 0:
            windows.add((max(0, place - at - edits), min(len(line), place - at + len(notice) + edits)))
            place = line.find(seed, place + 1)
    found, windows = set(), sorted(windows)
    for a, b in windows:
        if m := pattern.search(line, a, b):
            found.add((sum(m.fuzzy_counts), m.start(), m.end()))
    starts: list[int] = []
    ends: list[int] = []
    costs: list[int] = []

    def take(cost: int, a: int, b: int) -> None:
        k = bisect_right(starts, a)
        if b > a and (k == 0 or ends[k - 1] <= a) and (k == len(starts) or b <= starts[k]):
            starts.insert(k, a)
            ends.insert(k, b)
            costs.insert(k, cost)

    for cost, a, b in sorted(found):
        take(cost, a, b)
    for a, b in windows:
        at = a
        while at < b:  # the free parts of the window
            k = bisect_right(starts, at)
            if k and ends[k - 1] > at:
                at = ends[k - 1]
                continue
            stop = min(b, starts[k]) if k < len(starts) else b
            m = pattern.search(line, at, stop) if stop - at >= len(notice) - edits else None
            if m and m.end() > m.start():
                take(sum(m.fuzzy_counts), m.start(), m.end())
                at = m.end()
            else:
                at = max(stop, at + 1)
    return list(zip(starts, ends, costs, strict=True))


def scan_text(text: bytes, patterns: list) -> dict:
    """All columns of SCAN for one text."""
    words = text.translate(_KEEP).split()
    line = b" " + b" ".join(words) + b" "
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    n_base, first, last, base = 0, None, None, set()
    spans, best = [], 0.0
    for phrase, label in BASE.items():
        needle = f" {phrase} ".encode()
        at = line.find(needle)
        while at >= 0:
            word = int(np.searchsorted(blanks, at))
            n_base += 1
            base.add(label)
            first, last = word if first is None else min(first, word), word if last is None else max(last, word)
            spans.append({"label": label, "start": word, "end": word + phrase.count(" ") + 1, "edits": 0})
            best = 1.0
            at = line.find(needle, at + 1)
    labels = set(base)
    for notice, label, edits, pattern in patterns:
        for a, b, cost in fuzzy_spans(line, notice, edits, pattern):
            if cost == 0 and notice in BASE and line[a - 1 : a] == b" " and line[b : b + 1] == b" ":
                continue  # a base place
            labels.add(label)
            best = max(best, 1.0 - cost / len(notice))
            start = int(np.searchsorted(blanks, a + 1)) - 1
            spans.append({"label": label, "start": start, "end": start + len(line[a:b].split()), "edits": cost})
    spans.sort(key=lambda s: (s["start"], s["end"], s["label"]))
    return {
        "n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last,
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": best, "spans": spans,
    }


def compiled(notices=None) -> list:
    """Notices with their patterns; the best match of those within the bound is taken."""
    return [(n, label, k, regex.compile(f"(?b)(?:{re.escape(n)}){{e<={k}}}".encode())) for n, label, k in (NOTICES if notices is None else notices)]


def scan_licenses(docs: DataFrame, notices=None) -> DataFrame:
    """``docs`` with the license notices of each text.

    Words are lower-cased runs of letters and digits.  n_base, first_word, last_word and base_labels
    tell of the exact phrases; labels adds those of ``notices`` found with edits; score is the closeness of
    the closest notice (1 exact, 0 none); spans are word ranges with label and edits.  Columns of
    these names are replaced.  Null and empty texts have no words, empty labels, score 0.  Each row is
    scanned alone, so repeated rows agree and an empty table gives an empty result.
    """
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
    kind = pa.struct([*fields, ("spans", pa.list_(span))])

    @F.arrow_udf(SCAN)
    def scan(texts: pa.Array) -> pa.Array:
        patterns = compiled(notices)
        return pa.array([scan_text(t or b"", patterns) for t in texts.cast(pa.binary()).to_pylist()], kind)

    found = docs.select(*others(docs, [*OWN, "_scan"])).withColumn("_scan", scan("text"))
    return found.select("*", "_scan.*").drop("_scan")


def op7_license_scan(spark, sf_dir):
    """License notices of all documents."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
