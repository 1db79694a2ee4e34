"""WARC archives compressed with zstandard: a dictionary in the leading skippable frame and one frame per
record. The reader validates frame, header and length of every record and the digests of blocks and payloads.
It reads the archives of other writers too: all types of record, with or without a dictionary.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import struct
import uuid
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

DICTIONARY_MAGIC, ZSTD_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Payloads of fewer bytes are stored again rather than revisited.
REVISIT_BYTES = 100
#: The dictionary is trained on this many pages at most, of this many bytes each at most.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 16_384, 32_768
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A record of more bytes is refused, and so is a dictionary of more.
MOST_BYTES, MOST_DICTIONARY = 1 << 30, 1 << 26
#: Compressed bytes that are taken at a time.
STEP = 1 << 14
_DATE = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class WarcError(ValueError):
    """A damaged archive."""


# --- the format ----------------------------------------------------------------------------------


def record(kind: str, url: str, payload: bytes, digest: str, length: int, page_id: int | None, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit has an empty block and names the page whose payload it repeats."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}\n{url}\n{digest}\n{kind}')}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {''.join(url.splitlines())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {length}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and block of a record; both validated, with the block's and the
    payload's digest. Lines may be folded; of the fields only WARC-Concurrent-To may repeat (its values are
    joined by blanks)."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    try:
        lines = head.decode().split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError("the header is no UTF-8") from e
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC header")
    fields: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        last = name.lower()
        if not colon or not name or last in fields and last != "warc-concurrent-to":
            raise WarcError(f"bad header line {line[:80]!r}")
        fields[last] = f"{fields[last]} {value.strip()}" if last in fields else value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"{name} is missing")
    n = fields["content-length"]
    if not (n.isascii() and n.isdigit()) or len(rest) != int(n) + 4 or rest[int(n) :] != b"\r\n\r\n":
        raise WarcError("Content-Length does not match the record")
    block = rest[: int(n)]
    _check(fields.get("warc-block-digest"), block, "block")
    if fields["warc-type"] in ("response", "resource", "request", "metadata", "conversion") and "warc-segment-number" not in fields and "warc-truncated" not in fields:
        http, payload = split_http(fields, block)
        if http is None or b"transfer-encoding" not in http.lower():  # some writers hash what was sent, some what was meant
            _check(fields.get("warc-payload-digest"), payload, "payload")
    return fields, block


def _check(digest: str | None, data: bytes, what: str) -> None:
    """Compare with a digest field: hexadecimal or base32; other algorithms are not checked."""
    name, _, value = (digest or "").partition(":")
    if name.lower() not in ("sha1", "sha256", "sha512", "md5"):
        return
    own = hashlib.new(name.lower(), data).digest()
    try:
        told = bytes.fromhex(value) if len(value) == 2 * len(own) else base64.b32decode(value + "=" * (-len(value) % 8), casefold=True)
    except (ValueError, binascii.Error) as e:
        raise WarcError(f"the {what}'s digest is malformed") from e
    if told != own:
        raise WarcError(f"the {what}'s digest does not match")


def split_http(fields: dict[str, str], block: bytes) -> tuple[bytes | None, bytes]:
    """The HTTP header block and the payload; without HTTP the block is the payload."""
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return None, block
    for end in (b"\r\n\r\n", b"\n\n"):
        head, sep, payload = block.partition(end)
        if sep:
            return head, payload
    return block, b""


def encode_archive(records, dictionary: bytes, level: int = 3):
    """Yield an archive: the dictionary in a skippable frame, then one frame per record."""
    yield struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=True, write_content_size=True)
    for r in records:
        yield pack.compress(r)


def decode_archive(f, block: int = 1 << 18, most: int = MOST_BYTES):
    """Yield the records of an archive from a binary file, one frame at a time. The dictionary, if there is one,
    is in a skippable frame at the start; other skippable frames are passed over. All damage is a WarcError."""
    rest, held, first = b"", None, True

    def more(n: int) -> bool:
        """Have n bytes ready if the file has them."""
        nonlocal rest
        while len(rest) < n and (data := f.read(block)):
            rest += data
        return len(rest) >= n

    try:
        while more(1):
            if not more(8):
                raise WarcError("cut short")
            magic, length = struct.unpack("<II", rest[:8])
            if magic & 0xFFFFFFF0 == 0x184D2A50:
                if magic == DICTIONARY_MAGIC and first:
                    if length > MOST_DICTIONARY:
                        raise WarcError("the dictionary is too large")
                    if not more(8 + length):
                        raise WarcError("the dictionary is cut short")
                    data = rest[8 : 8 + length]
                    if data[:4] == struct.pack("<I", ZSTD_MAGIC):  # a dictionary may itself be compressed
                        data = zstandard.ZstdDecompressor().decompress(data, max_output_size=MOST_DICTIONARY)
                    held = zstandard.ZstdCompressionDict(data) if data else None
                    rest = rest[8 + length :]
                else:
                    left, rest = 8 + length - len(rest), rest[8 + length :]
                    while left > 0:
                        if not (data := f.read(min(left, block))):
                            raise WarcError("a skippable frame is cut short")
                        left -= len(data)
                first = False
                continue
            first = False
            if magic != ZSTD_MAGIC:
                raise WarcError("a record does not start with a frame")
            one, parts, size = zstandard.ZstdDecompressor(dict_data=held).decompressobj(), [], 0
            while True:
                parts.append(one.decompress(rest[:STEP]))
                size += len(parts[-1])
                if size > most:
                    raise WarcError(f"a record of more than {most} bytes")
                if one.eof:
                    rest = one.unused_data + rest[STEP:]
                    break
                rest = rest[STEP:]
                if not more(1):
                    raise WarcError("the last frame is cut short")
            yield b"".join(parts)
    except zstandard.ZstdError as e:
        raise WarcError(str(e)) from e


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for records, or none where there are too few samples."""
    samples = [s for s in samples if len(s) >= 8]
    if sum(map(len, samples)) < 8 * size or len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


# --- Spark ----------------------------------------------------------------------------------------


def plan_records(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Page rows as records to write: id, url, payload, digest, length, refers_to.

    Of equal payloads of ``least`` bytes or more, rows with the smallest id are responses and all others
    revisit it; null ids come last, and a group without any id is all responses, as are repeated rows of
    the smallest id. Null html is an empty payload. Digests are counted before the join, so a hot payload
    costs one row per task; the join itself carries each payload once and can be split by AQE.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "length": F.length("payload").cast("long")})
    first = rows.where(F.col("length") >= least).groupBy(F.col("digest").alias("_digest")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = C.materialize(first, "warc-first")
    joined = rows.join(first, F.col("digest") == F.col("_digest"), "left")
    other = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (F.col("length") >= least)
    return joined.select("id", "url", "payload", "digest", "length", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, path: str | None = None, dictionary: bytes = b"") -> DataFrame:
    """Write one archive per partition below ``path``; returns the manifest (path, n_records)."""
    path = path or C.scratch(records.sparkSession, "warc")

    def write(batches):
        C.begin("warc")
        def rows():
            for batch in batches:
                for part in C.sub_batches(batch, "payload"):
                    for r in part.to_pylist():
                        rec = "response" if r["refers_to"] is None else "revisit"
                        yield record(rec, r["url"], r["payload"] if rec == "response" else b"", r["digest"], r["length"], r["id"], r["refers_to"])
                        n[0] += 1

        n, name = [0], f"{path}/part-{TaskContext.get().partitionId():06d}.warc.zst"
        C.write_bytes_atomically(name, encode_archive(rows(), dictionary))
        yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [n[0]]})

    return C.materialize(records.mapInArrow(write, "path string, n_records long"), "warc-manifest")


def dictionary_for(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary from a bounded sample of pages; it affects compression only."""
    rows = pages.select(F.encode(F.substring(F.col(html), 1, SAMPLE_BYTES), "UTF-8").alias("p")).where("p is not null").limit(SAMPLE_PAGES).collect()
    return train([bytes(r.p) for r in rows])


def _whole(value: str | None, what: str) -> int | None:
    try:
        return None if value is None else int(value)
    except ValueError as e:
        raise WarcError(f"{what} is no number") from e


def _rows(batches, row, shape, size):
    """Batches of about 4 MB from (path, expected number or None) rows, by ``row`` of a record."""

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), shape)], names=[x for x, _ in shape])

    rows, held = [], 0
    for b in batches:
        for path, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got = 0
            with C.open_bytes(path) as f:
                for raw in decode_archive(f):
                    fields, block = parse(raw)
                    got += 1
                    rows.append(row(path, fields, block))
                    held += 100 + size(block)
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
            if expected is not None and got != expected:
                raise WarcError(f"{path} has {got} records of {expected}")
    if rows:
        yield batch(rows)


def read_archives(manifest: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """Records of the archives that ``write_archives`` wrote: page_id, payload_bytes, payload_digest, record_type,
    refers_to; with ``with_payload`` also url and payload (null for revisits). Damage raises WarcError."""
    n = manifest.count()
    shape = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("url", pa.string()), ("payload", pa.binary())] * with_payload
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload

    def row(path, h, block):
        kind, length = h["warc-type"], _whole(h.get("warc-payload-length"), "the payload's length")
        if length is None or kind == "response" and length != len(block):
            raise WarcError("the payload's length does not match")
        own = (_whole(h.get("warc-page-id"), "a page's id"), length, h.get("warc-payload-digest", "").removeprefix("sha256:"), kind, _whole(h.get("warc-refers-to-page-id"), "a page's id"))
        return own + ((h.get("warc-target-uri"), block if kind == "response" else None) if with_payload else ())

    def read(batches):
        C.begin("warc")
        yield from _rows(batches, row, shape, len if with_payload else lambda _: 0)

    return manifest.select("path", "n_records").repartition(max(1, n), "path").mapInArrow(read, schema)


_RECORDS = [
    ("path", pa.string()),
    ("record_type", pa.string()),
    ("record_id", pa.string()),
    ("date", pa.string()),
    ("target_uri", pa.string()),
    ("content_type", pa.string()),
    ("payload_digest", pa.string()),
    ("refers_to", pa.string()),
    ("http_status", pa.int32()),
    ("http_headers", pa.string()),
    ("payload", pa.binary()),
    ("fields", pa.map_(pa.string(), pa.string())),
]


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.warc.zst") -> DataFrame:
    """All records of the archives below a folder, of whatever writer: path, record_type, record_id, date,
    target_uri, content_type, payload_digest, refers_to (a record's id), http_status and http_headers (of
    records that hold HTTP messages), payload (what follows these headers), and all fields by lower-case name.
    What a record doesn't state is null. An archive is read by one task; damage raises WarcError. A folder
    without archives gives no rows."""
    C.reachable(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    paths = C.materialize(files.select("path", F.lit(None).cast("long").alias("n_records")), "warc-paths")  # a listing only
    schema = "path string, record_type string, record_id string, date string, target_uri string, content_type string, payload_digest string, refers_to string, http_status int, http_headers string, payload binary, fields map<string,string>"

    def row(path, h, block):
        http, payload = split_http(h, block)
        first = (http or b"").split(b"\r\n")[0].split(b" ")
        status = int(first[1]) if len(first) > 1 and first[0].startswith(b"HTTP/") and first[1].isdigit() and len(first[1]) < 9 else None
        return (path, h["warc-type"], h["warc-record-id"], h["warc-date"], h.get("warc-target-uri"), h.get("content-type"), h.get("warc-payload-digest"), h.get("warc-refers-to"), status, None if http is None else http.decode("utf-8", "replace"), payload, list(h.items()))

    def read(batches):
        C.begin("warc")
        yield from _rows(batches, row, _RECORDS, len)

    return paths.repartition(max(1, paths.count()), "path").mapInArrow(read, schema)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages to archives and read them back: one row per page."""
    return read_archives(write_archives(plan_records(pages), path, dictionary_for(pages)))


#: DuckDB SQL for ``archive``.
ARCHIVE_SQL = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first END AS refers_to
FROM (SELECT *, strlen(h) >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS revisit
      FROM (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))
"""
