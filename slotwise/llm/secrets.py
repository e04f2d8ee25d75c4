"""Secret scans with structural confirmation."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

Span = tuple[str, int, int]

#: Kinds in the order that breaks ties of start. The first three are the base patterns; the
#: others are reported only when what they encode parses as what it seems to be.
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")

_NAME = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = re.compile(_NAME + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so this is the pattern and its length at once
_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")  # maximal runs, each looked through once
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}KEY-----((?:[A-Za-z0-9+/=\s]|\\[nr])+)-----END [A-Z0-9 ]{0,40}KEY-----")
_BREAK = re.compile(r"\s+|\\[nr]")  # line ends as they are, or as JSON escapes them
_BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
_BASE64URL = re.compile(r"[A-Za-z0-9_-]{40,}={0,2}")
_LONG_HEX = re.compile(r"[0-9a-fA-F]{64,}")

#: What a text must hold, in a dialect that Arrow evaluates over whole batches, to have any
#: span. A text that it rejects has none.
_MAY_HOLD = "|".join(
    (_NAME + r"""["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{8}""", r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}", r"eyJ[A-Za-z0-9_-]+\.", r"-----BEGIN ", r"[A-Za-z0-9+/]{40}", r"[A-Za-z0-9_-]{40}", r"[0-9a-fA-F]{64}")
)


def base_spans(text: str) -> list[Span]:
    """The three base kinds: leftmost matches that don't overlap within a kind, short ones dropped."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return ordered(found)


def confirmed_spans(text: str) -> list[Span]:
    """Candidates whose decoded bytes have the structure of a key or a signed token."""
    found = [("jwt", m.start() + a, m.start() + b) for m in _DOTTED.finditer(text) if "eyJ" in m[0] for a, b in signed_tokens(m[0])]
    keys = [(m.start(), m.end(), _BREAK.sub("", m[1]), False) for m in _PEM.finditer(text)]
    inside = lambda m: any(a <= m.start() and m.end() <= b for a, b, _, _ in keys)
    bare = [(m.start(), m.end(), m[0], False) for m in _BASE64.finditer(text) if not inside(m)]
    bare += [(m.start(), m.end(), m[0].replace("-", "+").replace("_", "/"), False) for m in _BASE64URL.finditer(text) if ("-" in m[0] or "_" in m[0]) and not inside(m)]
    bare += [(m.start(), m.end(), m[0], True) for m in _LONG_HEX.finditer(text)]
    for start, end, body, is_hex in keys + bare:
        raw = _decoded(body, is_hex)
        if is_der_key(raw):
            found.append(("der", start, end))
        elif is_ssh_key(raw):
            found.append(("ssh", start, end))
    return ordered(set(found))


def all_spans(text: str) -> list[Span]:
    return ordered(base_spans(text) + confirmed_spans(text))


def ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _decoded(body: str, is_hex: bool) -> bytes:
    try:
        return bytes.fromhex(body) if is_hex else base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (ValueError, binascii.Error):
        return b""


def _object(raw: bytes, at: int = 0):
    """The JSON object that fills ``raw`` from ``at`` to its end, else None."""
    try:
        text = raw[at:].decode() if at else raw.decode()
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed_tokens(run: str) -> list[tuple[int, int]]:
    """(start, end) of the signed tokens in a run of base64url parts with dots.

    A token has three parts: a JSON header that names an algorithm, a JSON object, a signature
    (which an unsigned token may lack). The header may begin anywhere in its part, behind
    other letters, so its part is decoded in each of the four ways in which it may be aligned,
    and the leftmost header that fits is taken (behind other letters, a flat one). Tokens
    don't overlap.
    """
    parts, found, at = run.split("."), [], 0
    starts = [0]
    for p in parts:
        starts.append(starts[-1] + len(p) + 1)
    for i in range(len(parts) - 2):
        if starts[i] < at or "eyJ" not in parts[i] or not parts[i + 1].startswith("ey") or _object(_safe(parts[i + 1])) is None:
            continue
        best = None
        named = lambda x: isinstance(x, dict) and isinstance(x.get("alg"), str) and (bool(parts[i + 2]) or x["alg"].lower() == "none")  # noqa: B023, E731
        if named(_object(_safe(parts[i]))):
            best = 0
        for k in range(4):
            raw = _safe(parts[i][k:])
            head = _HEADER.search(raw)  # the last object of the part
            if head and head.start() % 3 == 0 and named(_object(raw, head.start())):
                start = k + head.start() // 3 * 4
                best = start if best is None else min(best, start)
        if best is not None:
            at = starts[i + 2] + len(parts[i + 2])
            found.append((starts[i] + best, at))
    return found


#: The last flat JSON object of some bytes, up to their end; headers of tokens are flat.
_HEADER = re.compile(rb'\{"[^{}]*\}\Z')


def _safe(part: str) -> bytes:
    try:
        return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))
    except (ValueError, binascii.Error):
        return b""


def _elements(raw: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill raw[start:end] exactly, or None."""
    found = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size, start = raw[start], raw[start + 1], start + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or start + n > end:
                return None
            size, start = int.from_bytes(raw[start : start + n], "big"), start + n
        if start + size > end:
            return None
        found.append((tag, start, start + size))
        start += size
    return found


def is_der_key(raw: bytes) -> bool:
    """A DER sequence whose nested lengths add up to a private or public key: PKCS#1, SEC1, PKCS#8 or SPKI."""
    top = _elements(raw, 0, len(raw)) if raw[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    parts = _elements(raw, *top[0][1:])
    if not parts:
        return False
    tags = [t for t, _, _ in parts]
    if tags[:2] == [0x02, 0x30] and 0x04 in tags[2:3] or tags == [0x30, 0x03]:  # PKCS#8; SPKI
        kind = _elements(raw, *parts[tags.index(0x30)][1:])
        return bool(kind) and kind[0][0] == 0x06
    if tags[:2] == [0x02, 0x04]:  # SEC1
        return parts[0][2] - parts[0][1] == 1 and raw[parts[0][1]] == 1
    return len(tags) >= 9 and tags[:9] == [0x02] * 9  # PKCS#1: the version and eight numbers


def is_ssh_key(raw: bytes) -> bool:
    """The magic of a private key container, or length-prefixed fields that fill a public key."""
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at + 4 <= len(raw):
        n = int.from_bytes(raw[at : at + 4], "big")
        fields.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return at == len(raw) and len(fields) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk-ssh|sk-ecdsa)-[a-z0-9@.-]{1,60}", fields[0]) is not None


def redacted(text: str) -> str:
    """``text`` with each secret, overlapping spans as one, replaced by a marker."""
    out, at = [], 0
    for _, start, end in all_spans(text):
        if start >= at:
            out += [text[at:start], "[REDACTED]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def _suspects(texts: pa.Array) -> Iterator[tuple[int, str]]:
    """(row, text) of the rows that may have a span."""
    for i in pc.indices_nonzero(pc.match_substring_regex(texts, _MAY_HOLD).fill_null(False)).to_pylist():
        yield i, texts[i].as_py()


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    The base patterns are as KINDS lists them. Beyond them, runs of base64 and hex and key
    blocks are decoded and reported as ``der`` or ``ssh`` when the nested lengths are those of
    a key, and dotted base64url as ``jwt`` when its header and claims parse. Spans are
    kind:start:end in code points, end exclusive, by start and then kind, comma-joined;
    base_sha256 is over those of the base kinds.

    Whole texts are scanned, in time that grows with their length, however long they are;
    Arrow first sets aside texts that can't hold any span. Null and empty texts have none. Ties
    of start go by kind, then end. Repeated rows and null doc_ids come out as they come in; other
    columns are ignored; an empty table gives an empty result.
    """
    none = hashlib.sha256(b"").hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            counts = {k: [0] * x.num_rows for k in KINDS[:3]}
            digests, spans = [none] * x.num_rows, [""] * x.num_rows
            for i, text in _suspects(x["t"]):
                base = base_spans(text)
                for kind, _, _ in base:
                    counts[kind][i] += 1
                digests[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(ordered(base + confirmed_spans(text)))
            arrays = [x["doc_id"], *(pa.array(counts[k], pa.int64()) for k in KINDS[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return arrow_map(rows, scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the secrets of ``text_col`` replaced by a marker, and ``length_col`` (if it
    is a column) set to the new number of characters where a text changed. Null and empty texts
    stay as they are, and so do all rows, repeated ones too; columns keep their names, whatever
    these are; an empty table gives an empty result."""
    measured = length_col in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            new = {i: r for i, text in _suspects(x[text_col]) if (r := redacted(text)) != text}
            if new:
                at = x.schema.get_field_index(text_col)
                texts = pa.array([new.get(i, t) for i, t in enumerate(x[text_col].to_pylist())], x.schema.field(at).type)
                x = x.set_column(at, x.schema.field(at), texts)
                if measured:
                    at = x.schema.get_field_index(length_col)
                    sizes = [len(new[i]) if i in new else n for i, n in enumerate(x[length_col].to_pylist())]
                    x = x.set_column(at, x.schema.field(at), pa.array(sizes, x.schema.field(at).type))
            yield x

    return arrow_map(docs, run, docs.schema)
