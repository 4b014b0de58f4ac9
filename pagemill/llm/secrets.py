"""Secret scans by a worklist of decoded layers.

The text itself is the first layer.  Whatever looks encoded in a layer (URL and Unicode escapes,
base64, compressed data inside base64) is decoded to a further layer, which is scanned and searched for
encodings in turn, until no new layer comes up.  Each character of a layer knows the range of
the original text it came from, so every finding is a span of the original.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tables import others, table

# fixed values: the kinds of secrets in their order, with their patterns and least lengths
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{HEX_CHARS},}}")

# parameters
LEAST_RUN = 16  # characters of base64 that are worth a try
# Decoded characters of one text beyond which no further layer is opened; such layers are counted in n_unread.
# Only data that is compressed again and again comes near it.
LAYER_CHARS = 64 << 20

# fixed values: escapes of one character each; an escaped escape sign counts as one step however often it is escaped
_PERCENT = r"%(?:25)*"
_REST = rf"{_PERCENT}[89abAB][0-9A-Fa-f]"  # a further byte of a UTF-8 character
_URL = re.compile(
    rf"{_PERCENT}[0-7][0-9A-Fa-f]|{_PERCENT}[cCdD][0-9A-Fa-f]{_REST}|{_PERCENT}[eE][0-9A-Fa-f](?:{_REST}){{2}}|{_PERCENT}[fF][0-4](?:{_REST}){{3}}"
)
_URL_BYTE = re.compile(rf"{_PERCENT}([0-9A-Fa-f]{{2}})")
_UNIT = r"\\u(?:005[cC]u)*"
_UNICODE = re.compile(
    rf"{_UNIT}[dD][89abAB][0-9A-Fa-f]{{2}}{_UNIT}[dD][c-fC-F][0-9A-Fa-f]{{2}}|{_UNIT}[0-9A-Fa-f]{{4}}"
    r"|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&(?:amp;)*#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"
)
_UNIT_VALUE = re.compile(rf"{_UNIT}([0-9A-Fa-f]{{4}})")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_RUN},}}={{0,2}}")
WRAPPED = (64, 76)  # letters of a line of wrapped base64
_WRAPPED = {n: re.compile(rf"(?:[A-Za-z0-9+/]{{{n}}}\r?\n)+[A-Za-z0-9+/]{{1,{n}}}={{0,2}}") for n in WRAPPED}
_URL_SAFE = str.maketrans("-_", "+/")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{16,}")  # of a run that is not readable as a whole; no secret is shorter


@dataclass(frozen=True)
class Layer:
    """Text with the range of the original that each of its characters stands for; the original has no ranges."""

    text: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    depth: int = 0

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            at = np.arange(len(self.text))
            return at, at + 1
        return self.starts, self.ends


def scan_layer(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets that stand in ``text`` as it is, by kind and start."""
    found = []
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _url_character(escape: str) -> str | None:
    """The character of URL escapes, None if their bytes are no UTF-8."""
    try:
        return bytes(int(x, 16) for x in _URL_BYTE.findall(escape)).decode()
    except UnicodeDecodeError:
        return None


def _character(escape: str) -> str | None:
    """The character of a Unicode escape, None if there is no such character."""
    if escape[0] == "&":
        number = escape[escape.index("#") + 1 : -1]
        code = int(number[1:], 16) if number[0] in "xX" else int(number)
    elif escape[1] == "x":
        code = int(escape[2:], 16)
    elif escape[2] == "{":
        code = int(escape[3:-1], 16)
    else:
        units = [int(u, 16) for u in _UNIT_VALUE.findall(escape)]
        code = units[0] if len(units) == 1 else 0x10000 + ((units[0] - 0xD800) << 10) + units[1] - 0xDC00
    return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)


def _unescaped(layer: Layer, pattern: re.Pattern, character) -> Layer | None:
    """The layer with the escapes of ``pattern`` replaced, None if it has none."""
    texts, starts, ends, last = [], [], [], 0
    s, e = None, None
    for m in pattern.finditer(layer.text):
        value = character(m[0])
        if value is None:
            continue
        if s is None:
            s, e = layer.ranges()
        a, b = m.span()
        texts += [layer.text[last:a], value]
        starts += [s[last:a], s[a : a + 1]]
        ends += [e[last:a], e[b - 1 : b]]
        last = b
    if s is None:
        return None
    texts.append(layer.text[last:])
    return Layer("".join(texts), np.concatenate([*starts, s[last:]]), np.concatenate([*ends, e[last:]]), layer.depth + 1)


def _inflated(raw: bytes, most: int) -> tuple[bytes | None, bool]:
    """(data, too much): what compressed ``raw`` holds, if it is such."""
    if raw[:2] == b"\x1f\x8b":
        opener = zlib.decompressobj(31)
    elif raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0:
        opener = zlib.decompressobj()
    elif raw[:3] == b"BZh":
        opener = bz2.BZ2Decompressor()
    elif raw[:6] == b"\xfd7zXZ\x00":
        opener = lzma.LZMADecompressor(memlimit=256 << 20)
    else:
        return None, False
    try:
        data = opener.decompress(raw, most + 1)
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
        return None, False
    return (None, True) if len(data) > most else (data, False)


def _readable(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return None if not text or _CONTROL.search(text) else text


def _runs(text: str):
    """(start, run) of base64, lines of wrapped base64 as one run."""
    end = 0
    for m in _RUN.finditer(text):
        if m.start() < end:
            continue
        wrapped = _WRAPPED[len(m[0])].match(text, m.start()) if len(m[0]) in WRAPPED else None
        m = wrapped or m
        end = m.end()
        yield m.start(), m[0]


def _unpacked(raw: bytes, most: int) -> tuple[bytes, int, bool]:
    """(data, steps, too much) of compressed data, which may hold compressed data again, even itself."""
    steps, over, seen = 0, False, set()
    while hash(raw) not in seen:
        seen.add(hash(raw))
        data, over = _inflated(raw, most)
        if data is None:
            break
        raw, steps = data, steps + 1
    return raw, steps, over


def _base64_layers(layer: Layer, most: int) -> tuple[list[Layer], int]:
    """(layers, n_unread) of the base64 runs of a layer.

    A run is text, or compressed, or has readable stretches, as other letters may touch the
    encoded ones; so each of the four ways to cut it into groups is tried.
    """
    out, unread = [], 0
    for at, run in _runs(layer.text):
        run = run.rstrip("=")
        letters = run.translate(_URL_SAFE)
        places = None
        if "\n" in run:
            places = np.array([i for i, c in enumerate(run) if c not in "\r\n"])
            letters = "".join(letters.split())
        for skip in range(4):
            body = letters[skip:]
            if len(body) % 4 == 1:
                body = body[:-1]
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
            data, steps, over = _unpacked(raw, most)
            unread += over
            if steps:
                text = _readable(data)
                if text is not None:
                    a, b = layer.origin(at + skip, at + len(run))
                    out.append(Layer(text, np.full(len(text), a), np.full(len(text), b), layer.depth + 1 + steps))
                break
            text = _readable(raw)
            parts = [(0, text)] if text is not None else [(m.start(), m[0].decode()) for m in _STRETCH.finditer(raw)]
            for begin, text in parts:
                s, e = layer.ranges()
                places = np.arange(len(run)) if places is None else places
                sizes = np.array([len(c.encode()) for c in text])
                first = begin + np.cumsum(sizes) - sizes
                # byte j lies in the letters 8j/6 to (8j+7)/6
                lo, hi = places[skip + first * 8 // 6], places[skip + ((first + sizes - 1) * 8 + 7) // 6]
                out.append(Layer(text, s[at + lo], e[at + hi], layer.depth + 1))
            if parts:
                break
    return out, unread


def scan_text(text: str, layer_chars: int = LAYER_CHARS) -> tuple[list[tuple[str, int, int, int]], int, int]:
    """(spans, n_layers, n_unread) of a text; spans are (kind, start, end, depth) by start, kind, end.

    Depth 0 are the secrets that stand in the text as it is, each of the others has the least depth it
    was found at.  A layer whose text and place were seen before is not opened again, which ends cycles.
    """
    found: dict[tuple[str, int, int], int] = {}
    open_, seen, n_layers, n_unread, left = deque([Layer(text)]), set(), 0, 0, layer_chars
    while open_:
        layer = open_.popleft()
        if layer.depth:
            if not layer.text:
                continue
            name = (layer.text, int(layer.starts.min()), int(layer.ends.max()))
            if name in seen:
                continue
            if len(layer.text) > left:
                n_unread += 1
                continue
            seen.add(name)
            left -= len(layer.text)
        n_layers += 1
        for kind, a, b in scan_layer(layer.text):
            found.setdefault((kind, *layer.origin(a, b)), layer.depth)
        inner, over = _base64_layers(layer, left)
        n_unread += over
        if "%" in layer.text:
            inner.append(_unescaped(layer, _URL, _url_character))
        if "\\" in layer.text or "&" in layer.text:
            inner.append(_unescaped(layer, _UNICODE, _character))
        open_ += [x for x in inner if x is not None]
    spans = sorted(((k, a, b, d) for (k, a, b), d in found.items()), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return spans, n_layers, n_unread


_FOUND = "struct<secrets:array<struct<kind:string,start:bigint,end:bigint,depth:int>>,n_layers:bigint,n_unread:bigint>"
OWN = ["secrets", "n_layers", "n_unread"]


def scan_secrets(docs: DataFrame, layer_chars: int = LAYER_CHARS) -> DataFrame:
    """``docs`` with the secrets of each text: secrets (kind, start, end, depth), n_layers, n_unread.

    Spans are code points of the original text, end exclusive, sorted by start, kind (assign, access, hex)
    and end; depth is the number of decodings around a secret, 0 for one that stands in the text.  n_unread counts
    layers left unread as the text's layers together pass ``layer_chars``.  Columns of these names
    are replaced, others stay.  Null and empty texts have no secrets and one layer.  Each row is
    scanned alone: repeated rows agree, an empty table gives an empty result.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())])
    kind = pa.struct([("secrets", pa.list_(span)), ("n_layers", pa.int64()), ("n_unread", pa.int64())])

    @F.arrow_udf(_FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for i in range(len(texts)):  # one Python string at a time
            spans, n_layers, n_unread = scan_text(texts[i].as_py() or "", layer_chars)
            secrets = [{"kind": k, "start": a, "end": b, "depth": d} for k, a, b, d in spans]
            rows.append({"secrets": secrets, "n_layers": n_layers, "n_unread": n_unread})
        return pa.array(rows, kind)

    found = docs.select(*others(docs, [*OWN, "_found"])).withColumn("_found", scan("text"))
    return found.select("*", "_found.*").drop("_found")


def _replaced(text: str, spans: list[tuple[str, int, int, int]]) -> str:
    out, last = [], 0
    for kind, a, b, _ in spans:
        if a > last or not out:
            out += [text[last:a], f"[{kind}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redacted(docs: DataFrame, layer_chars: int = LAYER_CHARS) -> DataFrame:
    """``docs`` with every span of a secret, encoded ones too, replaced in ``text`` by ``[kind]``.

    Spans that touch or overlap are one, named by the first of them.  Texts without a secret, null ones too, stay.
    """

    @F.arrow_udf("string")
    def replaced(texts: pa.Array) -> pa.Array:
        return pa.array((None if t is None else _replaced(t, scan_text(t, layer_chars)[0]) for t in (x.as_py() for x in texts)), pa.string())

    return docs.withColumn("text", replaced("text"))


def _listed(secrets: Column | str) -> Column:
    """The spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op12_secret_scan(spark, sf_dir):
    """Secrets of all documents, in the texts and in what is encoded in them."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["depth"] == 0)

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed("secrets").alias("spans"), "n_layers", "n_unread")
