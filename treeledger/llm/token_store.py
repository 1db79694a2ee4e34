"""Token-ID files: independent zstandard frames, a document index, and a trailing seek table with a
checksum per frame, so that a reader decompresses only the frames of the documents it asks for.

Layout of a file (all integers little-endian)::

    frame*        zstandard frames, each holding whole documents
    skippable     magic 0x184D2A5D: the document index, one entry per frame
                  (first ordinal u64, documents u32, smallest id i64, largest id i64)
    skippable     magic 0x184D2A5E: the seek table of the zstandard seekable format
                  (compressed size u32, decompressed size u32, low 32 bits of xxh64 u32 per frame,
                  then number of frames u32, descriptor 0x80, magic 0x8F92EAB1)

A decompressed frame: documents n u32; n ids i64; n validity bytes u8 (0: the id is null); n token counts
u32; all token ids u32.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as C

INDEX_MAGIC, SEEK_MAGIC, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: Token ids that a frame gathers before it is closed; a longer document has a frame of its own.
FRAME_IDS = 1 << 16
LEVEL = 3

# --- the file format -----------------------------------------------------------------------------


def _skippable(magic: int, payload: bytes) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


def encode_file(documents, frame_ids: int = FRAME_IDS, level: int = LEVEL):
    """Yield the bytes of a file for (doc_id or None, array of ids) pairs, frame by frame."""
    pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
    index, seek, ordinal = [], [], 0
    ids, counts, arrays, held = [], [], [], 0

    def close():
        nonlocal ids, counts, arrays, held, ordinal
        n = len(ids)
        known = [i for i in ids if i is not None]
        raw = b"".join([struct.pack("<I", n), np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is not None for i in ids], "u1").tobytes(), np.array(counts, "<u4").tobytes(), *(a.astype("<u4").tobytes() for a in arrays)])
        out = pack.compress(raw)
        index.append(struct.pack("<QIqq", ordinal, n, min(known, default=0), max(known, default=-1)))
        seek.append(struct.pack("<III", len(out), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        ordinal += n
        ids, counts, arrays, held = [], [], [], 0
        return out

    for doc_id, tokens in documents:
        if ids and held + len(tokens) > frame_ids:
            yield close()
        ids.append(doc_id)
        counts.append(len(tokens))
        arrays.append(tokens)
        held += len(tokens)
    if ids:
        yield close()
    yield _skippable(INDEX_MAGIC, b"".join(index))
    yield _skippable(SEEK_MAGIC, b"".join(seek) + struct.pack("<IBI", len(seek), 0x80, SEEKABLE))


class TokenFile:
    """Reads a file of this format from a seekable binary file object."""

    def __init__(self, f):
        self.f = f
        f.seek(0, 2)
        size = f.tell()
        if size < 17:
            raise ValueError("too short for a seek table")
        f.seek(size - 9)
        frames, descriptor, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE or descriptor != 0x80:
            raise ValueError("no seek table with checksums at the end")
        table = 12 * frames + 9
        f.seek(size - table - 8)
        magic, length = struct.unpack("<II", f.read(8))
        if magic != SEEK_MAGIC or length != table:
            raise ValueError("the seek table's frame is damaged")
        self.frames = np.frombuffer(f.read(12 * frames), "<u4").reshape(-1, 3)
        at = size - table - 8 - 28 * frames - 8
        if at != int(self.frames[:, 0].sum()):
            raise ValueError("frame sizes do not add up")
        f.seek(at)
        magic, length = struct.unpack("<II", f.read(8))
        if magic != INDEX_MAGIC or length != 28 * frames:
            raise ValueError("the document index is damaged")
        self.index = np.frombuffer(f.read(length), np.dtype([("first", "<u8"), ("n", "<u4"), ("low", "<i8"), ("high", "<i8")]))
        self.starts = np.cumsum(self.frames[:, 0], dtype=np.int64) - self.frames[:, 0]
        self.decompressed = 0

    def frame(self, k: int) -> list[tuple[int | None, np.ndarray]]:
        self.f.seek(int(self.starts[k]))
        size, length, check = (int(x) for x in self.frames[k])
        raw = zstandard.ZstdDecompressor().decompress(self.f.read(size), max_output_size=length)
        self.decompressed += 1
        if len(raw) != length or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        n = struct.unpack_from("<I", raw)[0]
        ids, valid, counts = np.frombuffer(raw, "<i8", n, 4), np.frombuffer(raw, "u1", n, 4 + 8 * n), np.frombuffer(raw, "<u4", n, 4 + 9 * n)
        tokens = np.frombuffer(raw, "<u4", -1, 4 + 13 * n)
        if int(counts.sum(dtype=np.int64)) != len(tokens):
            raise ValueError(f"frame {k}: counts do not match its ids")
        ends = np.cumsum(counts, dtype=np.int64)
        return [(int(i) if v else None, tokens[e - c : e]) for i, v, c, e in zip(ids, valid, counts, ends)]

    def __iter__(self):
        for k in range(len(self.frames)):
            yield from self.frame(k)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The token ids of every document with this id; only frames whose range holds it are read."""
        return [t for k in np.flatnonzero((self.index["low"] <= doc_id) & (doc_id <= self.index["high"])) for i, t in self.frame(int(k)) if i == doc_id]


# --- encoding --------------------------------------------------------------------------------------

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Chunks: a run of Latin letters that white space, a full stop, a comma or the end follows; or all up to
#: the next white space. No token of a vocabulary with the steps below crosses these places: white space is
#: dropped and runs of letters are separate from signs before any merge.
_CHUNK = re.compile(rf"[{_LATIN}]++(?![^ \t\n\r\f\v.,])|[^ \t\n\r\f\v]+")
_PLAIN = re.compile(rf"[{_LATIN}]+").fullmatch
#: The steps before the model, and the mark of a word's last token, of files that chunks are right for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
WORD_END = "</w>"


class ChunkEncoder:
    """Token ids of texts through the tokenizers library. Where the file has the steps above, texts are cut at
    blanks and line feeds, and the ids of what lies between are remembered, in two generations of at most
    ``most`` entries of at most LONGEST characters. What is unknown is cut into chunks; runs of Latin letters go
    straight to the library's model, as the steps before it would only lower-case them and spell their bytes,
    all other chunks take the whole path. Texts for any other file go to the library whole."""

    LONGEST = 64

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known, self.old = Tokenizer.from_file(path), most, {}, {}
        self.tokenize = self.tokenizer.model.tokenize
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.chunked = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == SPLITTER and spec["model"].get("end_of_word_suffix") == WORD_END
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        spell = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.spell = {c: "".join(spell[b] for b in chr(c).encode()) for c in range(128, 256)}

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN(chunk):
            low = chunk.lower()
            ids = [t.id for t in self.tokenize(low if low.isascii() else low.translate(self.spell))]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Bring words into memory; those too long for it are returned."""
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        known, old, long, tokenize, code = self.known, self.old, {}, self.tokenize, self.code
        for w in words:
            v = old.get(w)
            if v is None:
                if w.isalpha() and w.isascii():
                    v = array(code, [t.id for t in tokenize(w.lower())]).tobytes()
                else:
                    v = b"".join([self._part(c) for c in _CHUNK.findall(w)])
            if len(w) <= self.LONGEST:
                known[w] = v
            else:
                long[w] = v
        return long

    def _part(self, chunk: str) -> bytes:
        v = self.known.get(chunk) or self.old.get(chunk)
        if v is None:
            v = self._chunk(chunk)
            if len(chunk) <= self.LONGEST:
                self.known[chunk] = v
        return v

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if not self.chunked:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        words = text.replace("\n", " ").split(" ")
        found = list(map(self.known.get, words))
        if None in found:
            long = self._learn({w for w, v in zip(words, found) if v is None})
            known = self.known
            found = [v if v is not None else known[w] if len(w) <= self.LONGEST else long[w] for w, v in zip(words, found)]
        return np.frombuffer(b"".join(found), self.kind)


_encoders: dict[str, ChunkEncoder] = {}
C.keeps("tokens", _encoders.clear)


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


# --- Spark ------------------------------------------------------------------------------------------

_FILES = "shard long, path string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, *, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 1) -> DataFrame:
    """Encode every whole text and write the ids to files below ``path`` (default: the shared folder), in
    ascending order of ``doc_id`` over the files and within them. Returns the manifest: shard, path,
    n_docs, n_tokens, and ``start`` (ids of all shards before).

    Null text is an empty one; null ids come first; rows of equal id follow each other by their text, and
    repeated rows are written each. ``end_id`` is appended to every document unless None. An empty table
    gives an empty manifest. Columns other than these two are not read.
    """
    spark = docs.sparkSession
    path = path or C.scratch(spark, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.repartitionByRange("id", F.xxhash64("t")).sortWithinPartitions("id", F.xxhash64("t"), "t")

    def write(batches):
        C.begin("tokens")
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        shard, code, total = TaskContext.get().partitionId(), encoder(tokenizer), [0, 0]
        tail = np.array([] if end_id is None else [end_id], code.kind)

        def documents():
            batch = first
            while batch is not None:
                for part in C.sub_batches(batch, "t", 1 << 20):
                    for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        ids = np.concatenate([code.ids(t), tail])
                        total[0] += 1
                        total[1] += len(ids)
                        yield i, ids
                batch = next(batches, None)

        name = f"{path}/part-{shard:06d}.tok.zst"
        C.write_bytes_atomically(name, encode_file(documents()))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "n_docs": [total[0]], "n_tokens": [total[1]]}, schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    manifest = C.materialize(rows.mapInArrow(write, _FILES), "token-manifest")
    before = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))  # one row per file


def read_tokens(manifest: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start, n_tokens, ids_crc32 (unsigned crc32 of the ids as
    little-endian unsigned 32-bit integers), and with ``with_ids`` the ids themselves."""
    n = manifest.count()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    shape = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids

    def read(batches):
        C.begin("tokens")
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with C.open_bytes(path) as f:
                    tokens = TokenFile(f)
                    for k in range(len(tokens.frames)):
                        rows = []
                        for i, t in tokens.frame(k):
                            rows.append((i, start, len(t), zlib.crc32(t.tobytes()), *([t.astype("i8")] if with_ids else [])))
                            start += len(t)
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), shape)], names=[x for x, _ in shape])

    return manifest.select("path", "start").repartition(max(1, n), "path").mapInArrow(read, schema)
