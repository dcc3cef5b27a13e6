"""Secret scan that also looks inside encoded layers of a text.

A text is a layer. Escapes (percent, ``\\u``, ``\\x``, ``&#..;``) and runs of base64, with or
without compression inside, unwrap to further layers, which are scanned and unwrapped in turn
until no new layer appears. Every character of a layer remembers the code points of the original
text it stems from, so a finding in any depth maps back to a span of the original.
"""

from __future__ import annotations

import binascii
import hashlib
import itertools
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import map_rows, texts_of

KINDS = ("assign", "access", "hex")
KEYWORDS = ("passw", "secret", "token", "api")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_LEAST = 6
#: A run that is too short is dropped, and no shorter run lies inside it: least lengths in the pattern are the same.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ESCAPES = re.compile(
    r"((?:%[0-9A-Fa-f]{2})+)|((?:\\u[0-9A-Fa-f]{4})+)|((?:\\x[0-9A-Fa-f]{2})+)|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});"
)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: The same over several lines, as mail and key files wrap it.
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{16,}\r?\n[ \t]*)+[A-Za-z0-9+/_-]+={0,2}")
#: Bytes that one compressed layer may unfold to; beyond that only this head is scanned, and ``cut_layers`` counts it.
LAYER_BYTES = 1 << 26

SPANS = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "n_layers long, n_decoded long, cut_layers long"
)


def findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every finding in one layer, in order."""
    found = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


class Layer:
    """A text and, per stretch of it, the original code points: one to one, or all from one span."""

    def __init__(self, text: str, stretches: list[tuple[int, int, int, bool]]):
        self.text = text
        #: (start in the layer, original start, original end, whether code points match one to one)
        self.stretches = stretches
        self.starts = [s[0] for s in stretches]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        def at(position):
            begin, first, stop, plain = self.stretches[bisect_right(self.starts, position) - 1]
            return (first + position - begin, first + position - begin + 1) if plain else (first, stop)

        return at(start)[0], at(end - 1)[1]

    def pieces(self, start: int, end: int, shift: int) -> Iterator[tuple[int, int, int, bool]]:
        """Stretches of [start, end), moved to begin at ``shift``."""
        n = bisect_right(self.starts, start) - 1
        while n < len(self.stretches) and self.starts[n] < end:
            begin, first, stop, plain = self.stretches[n]
            cut = max(begin, start)
            yield cut - start + shift, first + (cut - begin if plain else 0), stop, plain
            n += 1


def unescape(layer: Layer) -> Layer | None:
    """The layer with all escapes decoded once, or None if it has none."""
    text = layer.text
    if not ("%" in text or "\\" in text or "&#" in text):
        return None
    parts, stretches, at, length = [], [], 0, 0
    for m in ESCAPES.finditer(text):
        percent, wide, narrow, decimal, hexadecimal = m.groups()
        if percent:
            new = bytes.fromhex(percent.replace("%", "")).decode("utf-8", "replace")
        elif wide:
            new = bytes.fromhex(wide.replace("\\u", "")).decode("utf-16-be", "replace")
        elif narrow:
            new = bytes.fromhex(narrow.replace("\\x", "")).decode("utf-8", "replace")
        else:
            code = int(decimal) if decimal else int(hexadecimal, 16)
            new = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
        if m.start() > at:
            stretches += layer.pieces(at, m.start(), length)
            parts.append(text[at : m.start()])
            length += m.start() - at
        if new:
            stretches.append((length, *layer.origin(m.start(), m.end()), False))
            parts.append(new)
            length += len(new)
        at = m.end()
    if not at:
        return None
    if at < len(text):
        stretches += layer.pieces(at, len(text), length)
        parts.append(text[at:])
    return Layer("".join(parts), stretches) if parts else None


def inflate(data: bytes) -> tuple[bytes, bool]:
    """Undo compression until a fixpoint or a repeat; also says whether a layer was cut."""
    seen, cut = set(), False
    while data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0:
        digest = hashlib.sha256(data).digest()
        if digest in seen:
            break
        seen.add(digest)
        new, rest, room = b"", data, LAYER_BYTES
        try:
            while rest and room and (not new or rest[:2] == b"\x1f\x8b"):  # members follow each other
                stream = zlib.decompressobj(47)
                new += stream.decompress(rest, room)
                cut |= bool(stream.unconsumed_tail)
                rest, room = stream.unused_data, LAYER_BYTES - len(new)
            cut |= rest[:2] == b"\x1f\x8b"
        except zlib.error:
            if not new:
                break
        data = new
    return data, cut


def unbase64(run: str) -> tuple[str, bool] | None:
    """Text inside a run of base64, or None if there is none.

    White space is dropped, damaged bytes are replaced; a layer is text if at most a tenth of all its
    characters are unprintable or replaced.
    """
    body = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        data = binascii.a2b_base64(body + "=" * (-len(body) % 4))
    except binascii.Error:
        return None
    data, cut = inflate(data)
    text = data.decode("utf-8", "replace")
    if text.isprintable() and "\ufffd" not in text:
        return (text, cut) if text else None
    odd = sum(1 for c in text if c == "\ufffd" or not (c.isprintable() or c in "\r\n\t"))
    return (text, cut) if odd * 10 <= len(text) else None


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Findings of the text itself, findings of all layers, number of inner layers, number of cut ones."""
    base = findings(text)
    spans, layers, cuts = set(base), 0, 0
    work, seen = [Layer(text, [(0, 0, len(text), True)])], set()

    def push(child: Layer) -> None:
        nonlocal layers
        mark = (hashlib.sha256(child.text.encode("utf-8", "surrogatepass")).digest(), child.origin(0, len(child.text)))
        if mark not in seen:
            seen.add(mark)
            layers += 1
            spans.update((s, kind, e) for start, kind, end in findings(child.text) for s, e in (child.origin(start, end),))
            work.append(child)

    while work:
        layer = work.pop()
        plain = unescape(layer)
        if plain is not None:
            push(plain)
        wrapped = WRAPPED.finditer(layer.text) if "\n" in layer.text else ()
        for m in itertools.chain(BASE64.finditer(layer.text), wrapped):
            found = unbase64(m[0])
            if found:
                cuts += found[1]
                push(Layer(found[0], [(0, *layer.origin(m.start(), m.end()), False)]))
    return base, sorted(spans), layers, cuts


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def _scan_rows(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        out = {c.split()[0]: [] for c in SPANS.split(", ")}
        for doc, text in zip(batch["doc_id"], batch["text"]):
            base, spans, layers, cuts = scan_text(text)
            counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            row = (doc, *counts, digest, joined(spans), layers, len(spans) - len(base), cuts)
            for column, value in zip(out.values(), row):
                column.append(value)
        yield out


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with the spans of its secrets, in code points of the whole text.

    A null text counts as empty; rows that repeat are reported each; an empty table gives no
    row; other columns are ignored. ``n_*`` and ``base_sha256`` tell of the text itself, ``spans``
    of all layers, ``n_decoded`` of what only inner layers show.
    """
    return map_rows(texts_of(docs), _scan_rows, SPANS)


def redact_text(text: str) -> str:
    """The text with every finding of any layer replaced by a mark; overlapping ones share a mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, kind, end in scan_text(text)[1]:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"[{KINDS[kind]} removed]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets cut out of ``text`` and, where it is a column, ``n_chars`` counted anew; all columns stay."""

    def rows(batches):
        for batch in batches:
            yield batch | {"text": [t if t is None else redact_text(t) for t in batch["text"]]}

    clean = map_rows(docs, rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
