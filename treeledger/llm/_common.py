"""What the operators of this subpackage share: shared storage, Arrow batches, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import io
import os
import re
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no shared folder and runs on one machine (tests).
DEFAULT_SHARED = "file:///tmp/checkpoints"
#: For Python workers, which live on from stage to stage: memory that is free goes back to the system.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "4194304"}
#: Text goes to workers in batches of about so many bytes: the setting, its default, and what takes the place of that.
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "64MB", "4MB")
#: Bits of a key filter: about so many for each key, and no more than these (32 MB).
KEY_BITS, MOST_BITS = 16, 1 << 28


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, besides their own path, and set
    how they hold memory, unless the session sets it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    for k, v in WORKER_ENV.items():
        env.setdefault(k, v)
    if spark.conf.get(ARROW_BYTES[0]) == ARROW_BYTES[1]:
        spark.conf.set(ARROW_BYTES[0], ARROW_BYTES[2])


_owner: str | None = None
_clear: dict = {}


def keeps(owner: str, clear) -> None:
    """Say how to let go of what an operator's module keeps in a worker between tasks."""
    _clear[owner] = clear


def begin(owner: str) -> None:
    """To be called in a worker where an operator's tasks start: workers live on from stage to stage, so what
    other operators have kept goes, and free memory goes back to the system."""
    global _owner
    if _owner != owner:
        for name, clear in _clear.items():
            if name != owner:
                clear()
        if _owner is not None:
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)
        _owner = owner


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see, as the session names it. Without one a cluster is
    an error, as its machines share no default."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = DEFAULT_SHARED
    return base.rstrip("/") + "/treeledger"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one evaluation, and a lineage that survives
    the loss of executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what ``materialize`` stored for these tables; nothing that is still to run may read them."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
        at = jvm.org.apache.hadoop.fs.Path(t._stored)
        at.getFileSystem(conf).delete(at, True)


class KeyFilter:
    """Tells rows whose columns may be among the keys' columns (of the same types) from rows whose columns are
    not. It never misses a key; about one other row in KEY_BITS passes too, and more where the keys are more than
    the filter has room for, so a join follows. It is a bitmap of KEY_BITS per key and of at most MOST_BITS, which
    goes through the driver and is broadcast; rows do not leave the JVM."""

    def __init__(self, keys: DataFrame, *columns: str):
        n, self.bits = keys.count(), 1 << 15
        while self.bits < min(KEY_BITS * n, MOST_BITS):
            self.bits *= 2
        at = self._place(columns) + 1  # Spark's bitmaps count from one
        rows = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
        words = [np.frombuffer(bytes(r.bits), "<i8").tolist() for r in rows]
        self.table = F.broadcast(keys.sparkSession.createDataFrame([(r.bucket - 1, w) for r, w in zip(rows, words)], "_bucket long, _words array<long>"))

    def _place(self, columns) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.bits))

    def _tested(self, df: DataFrame, columns, how: str, hit: bool) -> DataFrame:
        placed = df.withColumn("_place", self._place(columns))
        word = F.element_at("_words", (F.shiftright(F.col("_place").bitwiseAND(32767), 6) + 1).cast("int"))
        bit = F.coalesce(F.getbit(word, F.col("_place").bitwiseAND(63).cast("int")), F.lit(0))
        joined = placed.join(self.table, F.shiftright("_place", 15) == F.col("_bucket"), how)
        return joined.where(bit == int(hit)).select(*[F.col(f"`{c}`") for c in df.columns])

    def among(self, df: DataFrame, *columns: str) -> DataFrame:
        """The rows whose columns may be a key."""
        return self._tested(df, columns, "inner", True)

    def others(self, df: DataFrame, *columns: str) -> DataFrame:
        """The rows whose columns are none."""
        return self._tested(df, columns, "left", False)


def local_path(path: str) -> str | None:
    """The plain path of a ``file:`` URI or of a path without scheme, else None."""
    u = urlparse(path)
    if u.scheme in ("", "file"):
        return unquote(u.path) if u.scheme else path
    return None


def _remote(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_bytes_atomically(path: str, chunks) -> int:
    """Stream ``chunks`` to ``path``; the name appears only when the content is complete, so that a
    repeated or speculative task leaves the same file. Returns the number of bytes."""
    size, plain, part = 0, local_path(path), f"{path}.{uuid.uuid4().hex}.part"
    if plain is not None:
        os.makedirs(os.path.dirname(plain), exist_ok=True)
        tmp = local_path(part)
        with open(tmp, "wb") as f:
            for c in chunks:
                size += f.write(c)
        os.replace(tmp, plain)
        return size
    store, at = _remote(path)
    tmp = at + part[len(path):]
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(tmp) as f:
        for c in chunks:
            f.write(c)
            size += len(c)
    store.move(tmp, at)
    return size


def open_bytes(path: str):
    """A seekable binary file for ``path`` in any store that pyarrow reaches."""
    plain = local_path(path)
    if plain is not None:
        return open(plain, "rb")
    store, at = _remote(path)
    return io.BufferedReader(store.open_input_file(at))


def without(df: DataFrame, names) -> DataFrame:
    """Drop columns whose names an operator is about to add (compared without case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def stow(df: DataFrame, names):
    """Rename columns that clash with ``names``; the second value selects ``df``'s columns again, under
    their own names, from a frame that still has them."""
    taken = {n.lower() for n in names}
    put = {c: f"_stowed_{i}" for i, c in enumerate(df.columns) if c.lower() in taken}
    return (df.withColumnsRenamed(put) if put else df), lambda out: out.select(*[F.col(f"`{put.get(c, c)}`").alias(c) for c in df.columns])


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that identify a document by content: equal rows share the key and are treated alike."""
    return [F.col(doc_id).alias("_id"), F.md5(F.coalesce(F.col(text), F.lit("\0")).cast("binary")).alias("_digest")]


def sub_batches(batch: pa.RecordBatch, text: str | tuple[str, ...] = "text", budget: int = 4 << 20):
    """Cut a batch so that the text (or the columns) of each piece is about ``budget`` bytes (one row at least)."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in ([text] if isinstance(text, str) else text)]
    lengths = np.sum([np.asarray(pc.binary_length(c).fill_null(0)) for c in columns], axis=0)
    if not len(lengths):
        return
    group = (np.cumsum(lengths, dtype=np.int64) - lengths) // budget
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return [x or b"" for x in col.to_pylist()]


# --- words ---------------------------------------------------------------------------------------
# A word is a maximal run of a-z, 0-9 and characters beyond ASCII, after lower-casing A-Z. In UTF-8
# every byte of a character beyond ASCII is over 0x7F, so words can be found in bytes.

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two rounds of shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_BASE = np.uint64(0x5851F42D4C957F2D)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def word_hashes(data: bytes, block: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of the words of ``data``, in order. Works block by block, so that the temporary
    memory doesn't follow the length of a text."""
    if len(data) <= block:
        return _word_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + block)
        while end < len(data) and _IS_WORD[_LOWER[data[end]]]:
            end += 1
        out.append(_word_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def _word_hashes(data: bytes) -> np.ndarray:
    low = _LOWER[np.frombuffer(data, np.uint8)]
    is_word = np.zeros(len(low) + 2, np.int8)
    is_word[1:-1] = _IS_WORD[low]
    edge = np.flatnonzero(np.diff(is_word))
    if not len(edge):
        return np.empty(0, np.uint64)
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    at = np.flatnonzero(is_word[1:-1])
    first = np.cumsum(lengths) - lengths
    offset = np.arange(len(at)) - np.repeat(first, lengths)
    longest = int(lengths.max())
    power = _POWERS if longest <= len(_POWERS) else _powers(longest)
    sums = np.add.reduceat(_BYTE[low[at]] * power[offset], first)
    return mix(sums + lengths.astype(np.uint64))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= _BASE
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def fields(schema: T.StructType, *extra: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *extra])
