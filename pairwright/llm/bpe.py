"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The rank file (under 1 MB, checked) is read once by the driver and sent to the
workers; each worker builds one encoder.  A long text is cut before encoding
at safe boundaries: before a single space that stands between two characters
that are not white space.  No match of the pre-split pattern crosses such a
place and the pattern looks only forward over white space, so the pieces' ids
joined are the whole text's ids.  Decoding works on raw bytes, so ids that end
inside a character decode to exactly the bytes they stand for.

A null or empty text has no ids and decodes to no bytes; repeated rows get the
same ids; texts that spell a special token are ordinary text; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import regex
from pyspark.sql import DataFrame, SparkSession

from pairwright.llm.common import from_text, texts

MAX_RANK_FILE = 64 << 20
CUT_CHARS = 50_000
_SAFE = regex.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[str, object] = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_RANK_FILE + 1)
    if len(raw) > MAX_RANK_FILE:
        raise ValueError(f"{path}: over {MAX_RANK_FILE} bytes")
    return raw


def encoder(raw: bytes, pattern: str):
    """The worker's encoder for these ranks, built once per process."""
    import tiktoken

    key = hashlib.md5(raw + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        _ENCODERS[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def pieces(text: str, cut: int = CUT_CHARS):
    """The text in pieces of about ``cut`` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > cut:
        m = _SAFE.search(text, at + cut)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


def encode(enc, text: str, cut: int = CUT_CHARS) -> list[int]:
    if len(text) <= cut:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text, cut) for i in enc.encode_ordinary(p)]


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, cut: int = CUT_CHARS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (binary)."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(rank_file))

    def make():
        enc = encoder(shared.value, pattern)

        def work(batch: list[str]):
            ids = [encode(enc, t, cut) for t in batch]
            return ids, [enc.decode_bytes(i) for i in ids]
        return work

    return from_text(texts(docs, id_col, text_col), make, {"ids": "array<int>", "decoded": "binary"})


def encode_digest(docs: DataFrame, rank_file: str, pattern: str, cut: int = CUT_CHARS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (digests made beside the ids, which then need not move)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def make():
        enc = encoder(shared.value, pattern)
        names = [str(i) for i in range(enc.max_token_value + 1)]

        def work(batch: list[str]):
            rows = []
            for t in batch:
                ids = encode(enc, t, cut)
                rows.append((len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(),
                             hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
            return list(zip(*rows, strict=True)) or [()] * 3
        return work

    return from_text(texts(docs, id_col, text_col), make, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})
