"""Token-ID / binary output: documents' ids in range-coded blocks, in doc_id order.

Writing: documents are range-partitioned by doc_id; each partition becomes one
numbered file of the folder (a Parquet container written by Spark, so any
storage that Spark can write will do) whose rows are blocks in order: the
coded bytes (``rangecoder``: independent, checksummed) and the doc_ids and
lengths of the documents that end in the block.  The blocks coded together (up
to ``lanes``) start from one prior, the frequencies of all their ids, which the
first of them carries.  Every document's ids are
followed by the end id.  Reading needs one block and its prior, or one file for positions;
the files' totals (one row a file) give each file's first position.

The tokenizer file (under 16 MB, checked) is read by the driver and sent to
the workers.  The texts of an Arrow batch are cut together where no match of the
pre-tokenizer crosses (``_cut_table``; of another tokenizer than byte-level BPE only at blanks
that stand alone between two other characters).  Each distinct piece is asked for
once a batch, and the pieces' ids are kept in a bounded cache per worker.  Only ``add_special_tokens=False`` is
asked of the library: a text that spells an added token (<|endoftext|>) has
that token's id there, as the tokenizer file says.

Nulls and edge cases: a null or empty text has the end id only; null doc_ids
come first; rows that repeat a doc_id follow each other in the order of the
text's hash; ids of 65,536 and more are refused (ValueError); extra columns
are ignored; an empty table gives an empty folder and no rows.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.bpe import CUT_CHARS, pieces
from pairwright.llm.common import TIDY, keyed
from pairwright.llm.rangecoder import BLOCK, LANES, Prior, decode_blocks, encode_blocks
from pairwright.session import shuffle_partitions, staging_root

END_ID = 0
MAX_FILE, CACHE = 16 << 20, 1_000_000
BATCH = 1 << 23
#: One unit of the pre-tokenizer, of digits or of letters.
_SIMPLE = regex.compile(r" ?(?:\p{L}+|\p{N}+)")
_BLANK = re.compile(rb"(?<=[!-~]) (?=[!-~])")
#: Kinds of characters. Unsure: no cut beside it (white space beyond ASCII, what Unicode 3.2 did not know or had otherwise).
_UNSURE, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _SPACE, _WHITE = range(7)
_STATE: dict = {}


def read_tokenizer(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_FILE + 1)
    if len(raw) > MAX_FILE:
        raise ValueError(f"{path}: over {MAX_FILE} bytes")
    return raw


@cache
def _kinds() -> tuple[bytes, np.ndarray]:
    """Kinds of bytes (ASCII only) and of code points below 65,536."""
    kinds = np.zeros(1 << 16, np.uint8)
    old = unicodedata.ucd_3_2_0
    for i in range(33, 1 << 16):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind == old.category(c) and kind[0] not in "CZ":
            kinds[i] = {"L": _LETTER, "N": _DIGIT}.get(kind[0], _MARK)
    kinds[39], kinds[32], kinds[9:14] = _APOSTROPHE, _SPACE, _WHITE
    return bytes(kinds[:128]) + bytes(128), kinds


def _cut_table(plain: bool) -> bytes:
    """Whether a text is cut between two kinds (first << 3 | second).

    Of a plain tokenizer every cut is an end of a unit of the pre-tokenizer
    (``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``), whatever stands around:
    no unit holds letters before anything else, digits beside others, or what is not white space before white space;
    only an apostrophe may join the letters after it.
    """
    table, word = bytearray(256), (_LETTER, _DIGIT, _MARK, _APOSTROPHE)
    for a in word:
        table[a << 3 | _SPACE] = 1
        if plain:
            table[a << 3 | _WHITE] = table[_WHITE << 3 | a] = 1  # the second only behind a white space that stands alone
            for b in word:
                table[a << 3 | b] = a != b and {a, b} != {_MARK, _APOSTROPHE} and (a, b) != (_APOSTROPHE, _LETTER)
    return bytes(table)


class _Units(dict):
    """Ids (as uint16 bytes) of a piece of text, made when first asked for.

    Up to ``CACHE`` pieces of under 100 characters are kept, the first to be
    met: frequent words are among them.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet of byte-level BPE (fixed values)
        other = [b for b in range(256) if b not in printable]
        self.alphabet = {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(other)}}
        self.sure = frozenset(map(chr, np.flatnonzero(_kinds()[1] == _LETTER).tolist()))
        own = json.loads(tokenizer.to_str())
        self.added = [t["content"].encode() for t in own["added_tokens"]]
        #: Without a blank in it, an added token crosses no cut at a blank.
        self.whole = any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in own["added_tokens"])
        pre = own["pre_tokenizer"] or {}
        self.simple = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") \
            and own["model"]["type"] == "BPE" and not own["normalizer"] and (own["post_processor"] or {}).get("type", "ByteLevel") == "ByteLevel" \
            and not own["truncation"] and not own["padding"] \
            and all(self._model(w) == self._text(w) for w in (" the", " ün", " x", " Öffnungen", " 47", "here"))

    def _text(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, unit: str) -> bytes:
        """A blank (or none) and letters or digits only: one unit of the pre-tokenizer, so the model alone decides."""
        if unit.isascii():
            unit = self.alphabet[32] + unit[1:] if unit[0] == " " else unit
        else:
            unit = unit.encode("utf-8").decode("latin-1").translate(self.alphabet)
        return array("H", [t.id for t in self.model.tokenize(unit)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        stem = piece[1:] if piece[:1] == " " else piece
        if self.simple and stem.isalpha() and (stem.isascii() or self.sure.issuperset(stem)):
            ids = self._model(piece)
        elif self.simple and stem.isascii() and stem[-1:].isdigit() and _SIMPLE.fullmatch(piece):
            ids = self._model(piece)
        elif len(piece) > CUT_CHARS and not self.whole:
            ids = b"".join(map(self._text, pieces(piece)))
        else:
            ids = self._text(piece)
        if len(self) < CACHE and len(piece) < 100:
            self[piece] = ids
        return ids


class TextEncoder:
    """ids of texts as uint16 arrays, through the tokenizers library."""

    def __init__(self, raw: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(raw.decode("utf-8"))
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of 65,536 and more do not fit the format")
        self.known = _Units(self.tokenizer)
        self.table = _cut_table(self.known.simple)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_column(pa.array([text], pa.string())))[0]

    def encode_column(self, texts: pa.Array, batch: int | None = None):
        """ids of some texts and how many ids each has, for text after text of the column, about ``batch`` bytes at a time."""
        batch = batch or BATCH
        texts = texts.fill_null("").cast(pa.large_string())
        _, places, buffer = texts.buffers()
        if not len(texts):
            return
        ends = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(buffer or b"", np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + batch, side="right")) - 1)
            own = ends[i:j + 1] - ends[i]
            raw = data[ends[i]:ends[j]].tobytes()
            if len(raw) <= batch or self.known.whole:
                ids, at = self._encode(raw, own)
                yield ids, np.diff(at)
            else:  # a long text
                parts, begin = [], 0
                while begin < len(raw):
                    m = _BLANK.search(raw, begin + batch)
                    end = m.start() if m else len(raw)
                    parts.append(self._encode(raw[begin:end], np.array([0, end - begin]))[0])
                    begin = end
                yield np.concatenate(parts), np.array([sum(map(len, parts))])
            i = j

    def _cuts(self, raw: bytes, ends: np.ndarray) -> np.ndarray:
        """Where (in bytes) the pieces of the texts begin, and the end; every text's ``ends`` are among them."""
        cut = np.zeros(len(raw) + 1, bool)
        if not self.known.whole:
            ascii_kinds, by_point = _kinds()
            kinds = np.frombuffer(bytearray(raw.translate(ascii_kinds)), np.uint8)
            if not raw.isascii():
                data = np.frombuffer(raw, np.uint8)
                lead = np.flatnonzero(data >= 0xC2)
                head = data.take(lead).astype(np.int32)
                for at, own, more in ((lead[head < 0xE0], head[head < 0xE0] & 31, 1),
                                      (lead[(head >= 0xE0) & (head < 0xF0)], head[(head >= 0xE0) & (head < 0xF0)] & 15, 2)):
                    for k in range(1, more + 1):
                        own = own << 6 | data.take(at + k) & 63
                    own = by_point.take(own)
                    for k in range(more + 1):
                        kinds[at + k] = own
            cut[1:-1] = np.frombuffer((kinds[:-1] << 3 | kinds[1:]).tobytes().translate(self.table), bool)
            if self.known.simple:
                white = np.flatnonzero(kinds == _WHITE)
                before = kinds.take(np.maximum(white - 1, 0))
                alone = (white == 0) | (before >= _LETTER) & (before <= _APOSTROPHE)
                cut[white[~alone] + 1] = False
            if any(t in raw for t in self.known.added):
                for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
                    if any(raw.find(t, a, b) >= 0 for t in self.known.added):
                        cut[a:b] = False
        cut[ends] = True
        return np.flatnonzero(cut)

    def _encode(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the texts that ``raw`` joins, and their places among the ids."""
        if not raw:
            return np.empty(0, np.uint16), np.zeros(len(ends), np.int64)
        cuts, known = self._cuts(raw, ends), self.known
        found = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
        got = [known[p] for p in found.dictionary.to_numpy(zero_copy_only=False).tolist()]
        sizes = np.fromiter(map(len, got), np.int64, len(got)) >> 1
        which = found.indices.to_numpy()
        n = sizes.take(which)
        upto = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        at = np.repeat((np.cumsum(sizes) - sizes).take(which) - upto[:-1], n)
        at += np.arange(len(at))
        return np.frombuffer(b"".join(got), np.uint16).take(at), upto.take(np.searchsorted(cuts, ends))


def _encoder(raw: bytes) -> TextEncoder:
    key = zlib.crc32(raw)
    if key not in _STATE:
        _STATE[key] = TextEncoder(raw)
    return _STATE[key]


_KINDS = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
_ROW = "file int, block long, doc_ids array<long>, sizes array<long>, coded binary, prior binary"


def _write(shared, block: int, lanes: int, end_id: int):
    def rows(ids: np.ndarray, first: int, ends: list[tuple[int, int, int]]):
        parts = [ids[i:i + block] for i in range(0, len(ids), block)]
        owner: dict[int, list] = {}
        for end, doc, n in ends:
            owner.setdefault((end - 1) // block, []).append((doc, n))
        prior = Prior.of(parts)
        for i, coded in enumerate(encode_blocks(parts, prior)):
            own = owner.get(i, [])
            yield first + i, [d for d, _ in own], [n for _, n in own], coded, None if i else prior.dump()

    def run(batches):
        from pyspark import TaskContext
        file, encoder = TaskContext.get().partitionId(), _encoder(shared.value)
        held, size, ends, first = [], 0, [], 0

        def frame(got):
            cols = list(zip(*got, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([file] * len(got), pa.int32()), *(pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True))],
                                              names=["file", "block", "doc_ids", "sizes", "coded", "prior"])

        for b in batches:
            docs, i = b.column("doc_id").to_pylist(), 0
            for ids, sizes in encoder.encode_column(b.column("text")):
                sizes = sizes + 1
                upto = np.cumsum(sizes)
                new = np.full(len(ids) + len(sizes), end_id, np.uint16)
                text = np.ones(len(new), bool)
                text[upto - 1] = False
                new[text] = ids
                held.append(new)
                ends.extend(zip((upto + size).tolist(), docs[i:i + len(sizes)], sizes.tolist(), strict=True))
                i, size = i + len(sizes), size + len(new)
                while size >= block * lanes:
                    all_ids = np.concatenate(held)
                    now = block * lanes
                    done = [e for e in ends if e[0] <= now]
                    yield frame(list(rows(all_ids[:now], first, done)))
                    ends = [(e - now, d, n) for e, d, n in ends if e > now]
                    held, size, first = [all_ids[now:]], size - now, first + lanes
        if size:
            yield frame(list(rows(np.concatenate(held), first, ends)))
    return run


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, files: int | None = None,
          block: int = BLOCK, lanes: int = LANES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the folder ``path``; ``files``: number of files (default: the session's shuffle partitions)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_tokenizer(tokenizer_file))
    n = files or shuffle_partitions(spark)
    dealt = keyed(docs, id_col, text_col).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        dealt.select("doc_id", "text").mapInArrow(_write(shared, block, lanes, end_id), _ROW).write.parquet(path)
    finally:
        spark.conf.set(TIDY, before)


def _read(batches):
    """Documents of a file's blocks, in order; a document may span blocks and batches."""
    rest, file, at, todo, prior = [], None, 0, [], None
    for b in batches:
        new = np.flatnonzero(b.column("prior").is_valid().to_numpy(zero_copy_only=False)).tolist()  # a batch of blocks begins
        cuts = sorted({0, *new, *range(0, b.num_rows, LANES), b.num_rows})
        for i, j in zip(cuts, cuts[1:], strict=False):
            part = {c: x.to_pylist() for c, x in zip(b.schema.names, b.slice(i, j - i).columns, strict=True)}
            if part["prior"][0] is not None:
                prior = Prior.load(part["prior"][0])
            out = []
            for f, docs, sizes, ids in zip(part["file"], part["doc_ids"], part["sizes"], decode_blocks(part["coded"], prior), strict=True):
                if f != file:
                    if rest and sum(map(len, rest)):
                        raise ValueError("a file ends inside a document")
                    rest, file, at = [], f, 0
                rest.append(ids)
                todo = list(zip(docs, sizes, strict=True))
                if todo:
                    have, used = np.concatenate(rest), 0
                    for doc, n in todo:
                        n = int(n)
                        own = have[used:used + n]
                        if len(own) != n:
                            raise ValueError("a document is not whole")
                        out.append((file, doc, at, n, own))
                        used, at = used + n, at + n
                    rest = [have[used:]]
            yield out


def _documents(last: str, make, kind):
    """Record batches of file, doc_id, at, n_tokens and what ``make`` gives for a document's ids."""
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), kind)

    def run(batches):
        for out in _read(batches):
            cols = zip(*((f, d, at, n, make(own)) for f, d, at, n, own in out), strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file", "doc_id", "at", "n_tokens", last])
    return run


def _crc(own: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(own, dtype="<u4").tobytes())


def read(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (or ids) of every document in the folder."""
    blocks = spark.read.schema(_ROW).parquet(path)
    totals = blocks.groupBy("file").agg(F.sum(F.coalesce(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))).alias("n"))
    first, firsts = 0, {}
    for r in totals.orderBy("file").collect():  # one row a file
        firsts[r["file"]], first = first, first + r["n"]
    start = F.element_at(F.array(*[F.lit(firsts.get(f, 0)).cast("long") for f in range(max(firsts, default=0) + 1)]), F.col("file") + 1)
    n = max(1, len(firsts))
    dealt = blocks.repartitionById(n, "file").sortWithinPartitions("file", "block")  # a file to a task
    kind = "ids_crc32 long" if digest else "ids array<long>"
    make = _documents("ids_crc32", _crc, pa.int64()) if digest else _documents("ids", lambda own: own.astype(np.int64), pa.list_(pa.int64()))
    docs = dealt.mapInArrow(make, f"file int, doc_id long, at long, n_tokens long, {kind}")
    return docs.select("doc_id", (start + F.col("at")).alias("start"), "n_tokens", kind.split()[0])


def round_trip(docs: DataFrame, tokenizer_file: str, path: str | None = None, **options) -> DataFrame:
    """Writes a new folder in the session's shared one (or ``path``) and reads it back."""
    spark = docs.sparkSession
    path = path or f"{staging_root(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer_file, **options)
    return read(spark, path)
