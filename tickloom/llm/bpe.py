"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut at places that a rolling hash of the last 16 bytes selects, so a passage that many documents
share gives them the same chunks. A chunk that different texts share is encoded once, under
its 128-bit digest; its ids are joined to the documents that hold it. Where two chunks meet, the words at
the join are encoded again in a window that grows until the new ids agree with the recorded ones at both
ends; what is kept on either side is then what encoding the whole text gives.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, bit_filter, in_filter, slices

MIN_CHUNK, MAX_CHUNK, CUT_BITS = 128, 8192, 10
#: Bits of the filter of shared chunks, as a power of two (4 MB); fuller filters only share more than needed.
FILTER_BITS = 25
#: Words whose encodings a worker remembers in each of two generations, and the bytes of the longest such word.
MEMO_WORDS, MEMO_BYTES = 120_000, 64
#: A stretch without white space of more bytes is not cut: it goes whole into one chunk.
LONG_STRETCH = 1024
#: The tokenizer file's word pattern on printable lower-case ASCII, where its normaliser changes nothing and
#: its byte alphabet is the identity; other pieces go through the whole tokenizer.
ASCII_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
PLAIN_ASCII = re.compile(rb"[!-@\[-~]+")
GEAR = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def cuts(raw: bytes) -> list[int]:
    """Ends of the content-defined chunks of UTF-8 bytes; never inside a character."""
    n = len(raw)
    if n <= MIN_CHUNK:
        return [n] if n else []
    data = np.frombuffer(raw, np.uint8)
    rolled = GEAR[data]
    for width in (1, 2, 4, 8):
        wider = rolled * np.uint64(0x9E3779B97F4A7C15)
        wider[width:] += rolled[:-width]
        wider ^= wider >> np.uint64(29)
        rolled = wider
    ends = np.flatnonzero((rolled >> np.uint64(64 - CUT_BITS)) == 0) + 1
    spaces = np.flatnonzero(SPACES[data])

    def settled(at: int) -> int:
        """The first place from ``at`` on that lies neither inside a character nor inside a long stretch."""
        k = int(np.searchsorted(spaces, at))
        low, high = int(spaces[k - 1]) + 1 if k else 0, int(spaces[k]) if k < len(spaces) else n
        return high if high - low > LONG_STRETCH and at > low else whole_character(raw, at)

    out, start = [], 0
    for end in [*ends.tolist(), n]:
        while end - start > MAX_CHUNK:
            start = settled(start + MAX_CHUNK)
            out.append(start)
        if end - start >= MIN_CHUNK or end == n:
            end = settled(end)
            if end > start:
                out.append(end)
                start = end
    return out


def whole_character(raw: bytes, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


class Encoder:
    """Encodes byte strings piece by piece; pieces are what ASCII white space separates, which no token crosses.

    The encodings of pieces are remembered in two generations: when the young one is full it replaces the
    old one, so words in use stay and the memory is bounded.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = b"<|"  # what the file's special tokens begin with; they are matched before lower-casing
        self.names = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(self.tokenizer.get_vocab_size())]
        self.model = self.tokenizer.model
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def encode(self, raw: bytes) -> bytes:
        """Ids of the text as little-endian 32-bit integers."""
        if self.special in raw:
            pieces = raw.split()
        elif raw.isascii():
            pieces = raw.lower().split()  # the file's normaliser lower-cases too
        else:  # it composes characters before that, so pieces with others than ASCII are left to it
            pieces = [p.lower() if p.isascii() else p for p in raw.split()]
        out = [*map(self.young.get, pieces)]
        if None in out:
            return self.encode_new(pieces, out)
        return b"".join(out)

    def encode_new(self, pieces: list[bytes], out: list[bytes | None]) -> bytes:
        young, old, unseen = self.young, self.old, {}
        for k, ids in enumerate(out):
            if ids is None:
                piece = pieces[k]
                ids = young.get(piece) or old.get(piece)
                if ids is None and PLAIN_ASCII.fullmatch(piece) and self.special not in piece:
                    ids = b"".join([self.words.get(w) or self.encode_word(w) for w in ASCII_WORDS.findall(piece)])
                if ids is None:
                    unseen.setdefault(piece, []).append(k)
                else:
                    out[k] = ids
                    if len(piece) <= MEMO_BYTES:
                        young[piece] = ids
        if unseen:
            for piece, got in zip(unseen, self.tokenizer.encode_batch_fast([p.decode() for p in unseen], add_special_tokens=False)):
                ids = np.array(got.ids, "<u4").tobytes()
                if len(piece) <= MEMO_BYTES:
                    young[piece] = ids
                for k in unseen[piece]:
                    out[k] = ids
        if len(young) > MEMO_WORDS:
            self.old, self.young = young, {}
        return b"".join(out)

    def encode_word(self, word: bytes) -> bytes:
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
        ids = np.array([t.id for t in self.model.tokenize(word.decode())], "<u4").tobytes()
        if len(word) <= MEMO_BYTES:
            self.words[word] = ids
        return ids

    def assemble(self, raw: bytes, ends: list[int], known: dict[int, bytes]) -> bytes:
        """Ids of a text from those of its chunks; ``known`` has the ids of chunks encoded elsewhere, by number."""
        ids, start = bytearray(), 0
        for k, end in enumerate(ends):
            chunk = known[k] if k in known else self.encode(raw[start:end])
            ids = self.join(ids, raw, start, end, chunk) if start else bytearray(chunk)
            start = end
        return bytes(ids)

    def join(self, left: bytearray, raw: bytes, at: int, end: int, right: bytes) -> bytearray:
        """Appends the ids of raw[at:end] to those of raw[:at], encoding the words at the join anew."""
        if SPACES[raw[at - 1]] or SPACES[raw[at]]:  # no token crosses white space
            left += right
            return left
        words = 1
        while True:
            low, outer_low = breaks_before(raw, at, words), breaks_before(raw, at, words + 1)
            high, outer_high = breaks_after(raw, at, end, words), breaks_after(raw, at, end, words + 1)
            tail, head = self.encode(raw[outer_low:at]), self.encode(raw[at:outer_high])
            keep_left, keep_right = self.encode(raw[outer_low:low]), self.encode(raw[high:outer_high])
            middle = self.encode(raw[outer_low:outer_high])
            agree = left.endswith(tail) and right.startswith(head) and middle.startswith(keep_left) and middle.endswith(keep_right)
            if agree or (outer_low == 0 and outer_high == end):
                del left[len(left) - len(tail) :]
                left += middle
                left += right[len(head) :]
                return left
            words *= 2

    def decoded(self, ids: bytes) -> bytes:
        """The text that the tokenizer's decode gives: without a decoder, its tokens with spaces between."""
        names = self.names
        return b" ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """The worker's encoder: its memory of words serves all of the worker's tasks."""
    return Encoder(path)


def breaks_before(raw: bytes, at: int, words: int) -> int:
    """Start of the last ``words`` stretches before ``at`` that white space separates."""
    for _ in range(words):
        at -= 1
        while at > 0 and not SPACES[raw[at]]:
            at -= 1
        at = max(at, 0)
    return at


def breaks_after(raw: bytes, at: int, end: int, words: int) -> int:
    for _ in range(words):
        while at < end and not SPACES[raw[at]]:
            at += 1
        at = min(at + 1, end)
    return at


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def number(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def pieces_of(raw: bytes) -> Iterator[bytes]:
    start = 0
    for end in cuts(raw):
        yield raw[start:end]
        start = end


def results(ids: bytes, encoder: Encoder) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(encoder.decoded(ids)).hexdigest()


def shared_filter(docs: DataFrame) -> np.ndarray:
    """Filter of the digests of all chunks that different texts of the corpus share."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, of = [], []
            for raw in (t.encode() for t in batch.column("text").to_pylist() if t):
                chunks = [number(digest(c)) for c in pieces_of(raw)]
                found += chunks
                of += [number(digest(raw))] * len(chunks)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(of, pa.int64())], names=["key", "of"])

    texts = docs.select("text").mapInArrow(keys, "key long, of long").groupBy("key").agg(F.min("of").alias("low"), F.max("of").alias("high"))
    return bit_filter(texts.where("low <> high").select("key"), FILTER_BITS)


def encode(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, and its ``ids`` if asked for.

    The ids are those of the tokenizer file for the whole text, without added special tokens, truncation or
    padding; ``decoded_sha256`` is the digest of what decoding them, special tokens included, gives. A null
    text counts as empty: no tokens. Repeated rows get equal results; an empty table gives an empty result;
    further columns are not read. A text may be as long as a row can be: it is encoded chunk by chunk, only a
    stretch without white space of more than ``LONG_STRETCH`` bytes is one chunk, however long.
    ``tokenizer_path`` must be readable on every executor.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shared_filter(docs))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoder_of(tokenizer_path), zstandard.ZstdCompressor(3)
        sent_texts: set[bytes] = set()
        sent_chunks: set[bytes] = set()
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = (text or "").encode()
                parts = list(pieces_of(raw))
                keys = [digest(p) for p in parts]
                may = in_filter(shared.value, np.array([number(k) for k in keys], np.int64).view(np.uint64), FILTER_BITS).tolist() if keys else []
                row = {"doc_id": doc_id, "text_id": digest(raw), "n_tokens": None, "ids_sha256": None, "decoded_sha256": None, "ids": None, "packed": None, "refs": None, "fresh": None}
                if not any(may):
                    ids = encoder.assemble(raw, cuts(raw), {})
                    row["n_tokens"], row["ids_sha256"], row["decoded_sha256"] = results(ids, encoder)
                    row["ids"] = ids if with_ids else None
                elif row["text_id"] not in sent_texts:
                    sent_texts.add(row["text_id"])
                    row["packed"] = packer.compress(raw)
                    row["refs"] = [{"no": k, "id": key} for k, (key, m) in enumerate(zip(keys, may)) if m]
                    row["fresh"] = []
                    for key, part, m in zip(keys, parts, may):
                        if m and key not in sent_chunks:
                            sent_chunks.add(key)
                            row["fresh"].append({"id": key, "chunk": part})
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=first_schema)

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for batch in slices(batches):
            found = [encoder.encode(c) for c in batch.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "chunk_ids"])

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, unpacker = encoder_of(tokenizer_path), zstandard.ZstdDecompressor()
        for batch in slices(batches):
            rows = []
            for text_id, packed, got in zip(*(batch.column(c).to_pylist() for c in ("text_id", "packed", "got"))):
                raw = unpacker.decompress(packed)
                ids = encoder.assemble(raw, cuts(raw), {x["no"]: x["chunk_ids"] for x in got})
                rows.append((text_id, *results(ids, encoder), ids if with_ids else None))
            columns = list(zip(*rows)) or [[]] * 5
            types = (pa.binary(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["tid", "n2", "ids2", "decoded2", "raw2"])

    first_schema = pa.schema([
        ("doc_id", pa.int64()), ("text_id", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
        ("ids", pa.binary()), ("packed", pa.binary()), ("refs", pa.list_(pa.struct([("no", pa.int32()), ("id", pa.binary())]))),
        ("fresh", pa.list_(pa.struct([("id", pa.binary()), ("chunk", pa.binary())]))),
    ])
    first_ddl = (
        "doc_id long, text_id binary, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, packed binary, "
        "refs array<struct<no int, id binary>>, fresh array<struct<id binary, chunk binary>>"
    )
    first = Scratch(docs.sparkSession).keep(docs.select("doc_id", "text").mapInArrow(first_pass, first_ddl))
    chunks = first.select(F.inline("fresh")).groupBy("id").agg(F.first("chunk").alias("chunk"))
    encoded = chunks.mapInArrow(encode_chunks, "id binary, chunk_ids binary")
    texts = first.where("packed is not null").groupBy("text_id").agg(F.first("packed").alias("packed"), F.first("refs").alias("refs"))
    got = (
        texts.select("text_id", F.inline("refs"))
        .join(encoded, "id")
        .groupBy("text_id")
        .agg(F.collect_list(F.struct("no", "chunk_ids")).alias("got"))
    )
    whole = texts.select("text_id", "packed").join(got, "text_id").mapInArrow(last_pass, "tid binary, n2 long, ids2 string, decoded2 string, raw2 binary")
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    late = first.where("n_tokens is null").select("doc_id", "text_id").join(whole, F.col("text_id") == F.col("tid"))
    late = late.select("doc_id", "n2", "ids2", "decoded2", *(["raw2"] if with_ids else []))
    return first.where("n_tokens is not null").select(*columns).union(late)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and text of encoded documents (doc_id, ids): the tokenizer's decode, special tokens kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for batch in slices(batches):
            texts = [encoder.decoded(ids or b"").decode() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
