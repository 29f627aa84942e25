"""Secret scan: keyword automaton first, anchored expressions near its hits, then embedded checksums."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import slices

#: Kinds in the order in which spans at one place are listed; the first three make the base result.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = KINDS[:3]
#: Lower-case keyword -> kind. Each kind's expression starts with one of its keywords.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}
PATTERNS = {
    "assign": re.compile(
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
}
JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
HEX_RUN = 32
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_BYTE = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))


def checksum62(body: str) -> str:
    """CRC-32 of the body in six base-62 digits, as some issuers put at the end of a token."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def sound(kind: str, match: re.Match) -> bool:
    """Does the match pass its kind's length or checksum test?"""
    if kind == "assign":
        return len(match[1]) >= 8
    if kind == "access":
        return len(match[0]) >= 16
    if kind in ("github", "npm"):
        return checksum62(match[1][:30]) == match[1][30:]
    if kind == "jwt":
        try:
            head = json.loads(base64.urlsafe_b64decode(match[1] + "=" * (-len(match[1]) % 4)))
        except (ValueError, RecursionError):  # no JSON, or nested deeper than any header
            return False
        return isinstance(head, dict) and "alg" in head
    return True


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def hex_runs(raw: bytes, as_text: bool) -> Iterator[tuple[int, int]]:
    """Maximal runs of at least 32 lower-case hexadecimal digits, in code points.

    Every such run covers a multiple of 32, so only these places are looked at, and each hit is widened.
    """
    is_hex = HEX_BYTE[np.frombuffer(raw, np.uint8)[HEX_RUN - 1 :: HEX_RUN]]
    last, passed, points = -1, 0, 0  # bytes that are passed, and the code points in them
    for at in (np.flatnonzero(is_hex) * HEX_RUN + HEX_RUN - 1).tolist():
        if at < last:
            continue
        low = high = at
        while low > 0 and HEX_BYTE[raw[low - 1]]:
            low -= 1
        while high < len(raw) and HEX_BYTE[raw[high]]:
            high += 1
        last = high
        if high - low >= HEX_RUN:
            if as_text:
                points, passed = points + len(raw[passed:low].decode()), low
            start = points if as_text else low
            yield start, start + high - low


def find_spans(text: str, keywords: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, rank of the kind, end) of every secret of a text, sorted."""
    raw = text.encode()
    lowered = raw.lower().decode()  # only A-Z change, so places stay
    hits = sorted((end - length + 1, kind) for end, (length, kind) in keywords.iter(lowered))
    done, spans = dict.fromkeys(KINDS, 0), [(a, KINDS.index("hex"), b) for a, b in hex_runs(raw, len(raw) != len(text))]
    for start, kind in hits:
        if start < done[kind]:
            continue
        if match := PATTERNS[kind].match(text, start):
            done[kind] = match.end()
            if sound(kind, match):
                spans.append((start, KINDS.index(kind), match.end()))
        elif kind == "jwt" and (run := JWT_RUN.match(text, start)):
            done[kind] = run.end()  # what follows the run is missing for every later place in it too
    return sorted(spans)


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per input row.

    ``spans`` is "kind:start:end" in code points, end exclusive, by start and then kind, comma-joined. The
    base kinds are always there; the further kinds carry a checksum or structure that is validated. A null
    or empty text has no spans; a repeated row is scanned again; an empty table gives an empty result; further
    columns are not read. A very long text is scanned whole, in time proportional to its length. A token whose
    header is no JSON object, or nested too deeply to be read, is no span.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in slices(batches):
            counts, bases, alls = {k: [] for k in BASE}, [], []
            for text in batch.column("text").to_pylist():
                spans = find_spans(text or "", keywords)
                listed = [(KINDS[k], f"{KINDS[k]}:{a}:{b}") for a, k, b in spans]
                for k in BASE:
                    counts[k].append(sum(kind == k for kind, _ in listed))
                bases.append(hashlib.sha256(",".join(x for kind, x in listed if kind in BASE).encode()).hexdigest())
                alls.append(",".join(x for _, x in listed))
            columns = [batch.column("doc_id").cast(pa.int64()), *[pa.array(counts[k], pa.int64()) for k in BASE], pa.array(bases, pa.string()), pa.array(alls, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
