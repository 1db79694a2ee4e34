"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines chooses the boundaries, so that an insertion shifts
only the chunks around it. Chunks of several lines that occur anywhere before in the corpus are removed
after their bytes have been compared. With ``pairs``, so are all pairs of neighbouring lines, wherever the
boundaries fall: that cuts every repeated passage of two lines or more to its ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: The rolling hash covers so many lines; a chunk ends where it is divisible by DIVISOR.
ROLLING, DIVISOR = 2, 2
#: Lines of a chunk. Chunks of fewer lines than MIN_LINES (at the end of a text) are never removed.
MIN_LINES, MAX_LINES = 2, 16
_MASK = (1 << 64) - 1
_MULTIPLIER = 0x9E3779B97F4A7C15


def chunks(text: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The lines of a text and its chunks as line ranges [start, end)."""
    if not text:
        return [], []
    lines = text.split(b"\n")
    out, start, hashes = [], 0, []
    out_of_window = pow(_MULTIPLIER, ROLLING, 1 << 64)
    rolling = 0
    for i, line in enumerate(lines):
        h = xxhash.xxh3_64_intdigest(line)
        hashes.append(h)
        rolling = (rolling * _MULTIPLIER + h) & _MASK
        if i >= ROLLING:
            rolling = (rolling - hashes[i - ROLLING] * out_of_window) & _MASK
        n = i + 1 - start
        if n >= MAX_LINES or n >= MIN_LINES and ((rolling ^ (rolling >> 29)) * 0xBF58476D1CE4E5B9 & _MASK) >> 32 & (DIVISOR - 1) == 0:
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return lines, out


def ranges(text: bytes, pairs: bool) -> tuple[list[bytes], list[tuple[int, int]], list[tuple[int, int]]]:
    """The lines of a text, its chunks, and in order the line ranges that can be removed: chunks of MIN_LINES
    lines or more with a character that is no blank and, with ``pairs``, each line with such a character to
    the next one, with the blank lines between."""
    lines, found = chunks(text)
    out = [(a, b) for a, b in found if b - a >= MIN_LINES and any(map(bytes.strip, lines[a:b]))]
    if pairs:
        full = [k for k, x in enumerate(lines) if x.strip()]
        out = sorted({*out, *((a, b + 1) for a, b in zip(full, full[1:]))})
    return lines, found, out


def _long(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _occurrences(docs: DataFrame, pairs: bool) -> DataFrame:
    """(cid, _id, _text, pos) of every range that can be removed."""
    schema = pa.schema([("cid", pa.int64()), ("_id", pa.int64()), ("_text", pa.int64()), ("pos", pa.int32())])

    def run(batches):
        C.begin("lines")
        for batch in batches:
            for part in C.sub_batches(batch, "t"):
                cid, row, pos = [], [], []
                for k, t in enumerate(C.texts(part, "t")):
                    lines, _, found = ranges(t, pairs)
                    for p, (a, b) in enumerate(found):
                        cid.append(_long(xxhash.xxh3_64_intdigest(b"\n".join(lines[a:b]))))
                        row.append(k)
                        pos.append(p)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), part.column(0).take(at), part.column(1).take(at), pa.array(pos, pa.int32())], schema=schema)

    return docs.mapInArrow(run, "cid long, _id long, _text long, pos int")


def _bytes_of(docs: DataFrame, pairs: bool) -> DataFrame:
    """The bytes of the listed ranges of each document."""

    def run(batches):
        C.begin("lines")
        for batch in batches:
            for part in C.sub_batches(batch, "t"):
                rows = []
                for i, x, t, places in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), C.texts(part, "t"), part.column(3).to_pylist()):
                    lines, _, found = ranges(t, pairs)
                    rows += [(p["cid"], i, x, p["pos"], p["first"], b"\n".join(lines[slice(*found[p["pos"]])])) for p in places]
                cols = list(zip(*rows)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["cid", "_id", "_text", "pos", "first", "bytes"])

    return docs.mapInArrow(run, "cid long, _id long, _text long, pos int, first boolean, bytes binary")


def removals(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", pairs: bool = False) -> DataFrame:
    """(_id, _text, places): ranges to remove from each document that repeats an earlier one, where _text is
    xxhash64 of the text. Of equal ranges the first by (doc_id, xxhash64 of the text, place) stays; a null
    id comes first. Rows with equal id and text are one document here and are treated alike. The first
    occurrence of a line in the corpus is in no range that repeats an earlier one, so that no line is lost.

    Occurrences travel as four numbers; only ranges whose hash repeats travel with their bytes, and only
    texts that have such a range are shuffled. A hot range is one row per task in the count, and the joins by
    chunk can be split by AQE, as both sides are plain exchanges of stored tables. Ids are whole numbers (long).
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_text"), F.col(text).alias("t")).where("t is not null")
    places = C.materialize(_occurrences(rows, pairs), "chunk-places")
    first = places.groupBy("cid").agg(F.min(F.struct("_id", "_text", "pos")).alias("f"), F.max(F.struct("_id", "_text", "pos")).alias("l")).where("f != l").select(F.col("cid").alias("_cid"), "f")
    first = C.materialize(first, "chunk-first")
    again = C.KeyFilter(first, "_cid").among(places, "cid")
    wanted = again.join(first, F.col("cid") == F.col("_cid")).select("cid", "_id", "_text", "pos", F.struct("_id", "_text", "pos").eqNullSafe(F.col("f")).alias("first"))
    wanted = wanted.groupBy("_id", "_text").agg(F.collect_set(F.struct("cid", "pos", "first")).alias("places"))
    wanted = C.materialize(wanted.withColumnsRenamed({"_id": "_i", "_text": "_x"}), "chunk-wanted")
    C.drop(places, first)
    same_row = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_x"))
    rows = C.KeyFilter(wanted, "_i", "_x").among(rows, "_id", "_text")
    found = rows.join(wanted, same_row).select("_id", "_text", "t", "places")
    found = C.materialize(_bytes_of(found, pairs), "chunk-bytes")
    kept = found.where("first").select(F.col("cid").alias("_cid"), F.col("bytes").alias("_bytes"))
    equal = found.where("not first").join(kept, (F.col("cid") == F.col("_cid")) & (F.col("bytes") == F.col("_bytes")), "left_semi")
    out = C.materialize(equal.groupBy("_id", "_text").agg(F.sort_array(F.collect_set("pos")).alias("places")), "chunk-removals")
    C.drop(wanted, found)
    return out


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", added: bool = False, pairs: bool = False) -> DataFrame:
    """Documents without the multi-line chunks that repeat earlier ones (with ``pairs``, without all
    neighbouring lines that do), same columns and rows; with ``added`` also n_lines, n_removed_lines and
    n_removed_chunks, those of which no line is left (columns of these names are replaced).

    Null and empty texts stay as they are and have no lines; white-space-only chunks are never removed; a
    text of which all is removed becomes empty; single lines are never removed; an empty table gives an
    empty one; repeated rows are treated alike. Only documents that may lose lines are shuffled.
    """
    extra = ["n_lines", "n_removed_lines", "n_removed_chunks"]
    plain, restore = (C.without(docs, extra), None) if added else C.stow(docs, extra)
    gone = removals(docs, doc_id=doc_id, text=text, pairs=pairs).withColumnsRenamed({"_id": "_i", "_text": "_x", "places": "_places"})
    keyed = plain.withColumns({"_own": F.col(doc_id).cast("long"), "_text": F.xxhash64(text)})
    told = C.KeyFilter(gone, "_i", "_x")
    some = told.among(keyed, "_own", "_text").join(gone, F.col("_own").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_x")), "left").drop("_i", "_x")
    joined = told.others(keyed, "_own", "_text").withColumn("_places", F.lit(None).cast("array<int>")).unionByName(some).drop("_own", "_text")
    schema = C.fields(joined.drop("_places").schema, *joined.limit(0).select(*[F.lit(0).cast("long").alias(c) for c in extra]).schema)

    def run(batches):
        C.begin("lines")
        for batch in batches:
            for part in C.sub_batches(batch, text):
                k, g = part.schema.get_field_index(text), part.schema.get_field_index("_places")
                valid = part.column(k).is_valid().to_pylist()
                new, counts = [], []
                for t, v, places in zip(C.texts(part, text), valid, part.column(g).to_pylist()):
                    lines, found, places_of = ranges(t, pairs) if places else (t.split(b"\n") if t else [], (), ())
                    cut = {k for p in places or () for k in range(*places_of[p])}
                    if cut:
                        t = b"\n".join([x for k, x in enumerate(lines) if k not in cut])
                    new.append(t.decode() if v else None)
                    counts.append((len(lines), len(cut), sum(cut.issuperset(range(a, b)) for a, b in found)))
                arrays = list(part.columns)
                arrays[k] = pa.array(new, part.schema.field(k).type)
                names = list(part.schema.names)
                del arrays[g], names[g]
                numbers = np.array(counts, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(numbers[:, c]) for c in range(3))], names=[*names, *extra])

    out = joined.mapInArrow(run, schema)
    return out if added else restore(out)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, n_removed_chunks, text_sha256 (of the text that is left)."""
    out = dedup_lines(docs.select("doc_id", "text"), added=True, pairs=True)
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", C.sha256_hex(F.coalesce("text", F.lit(""))).alias("text_sha256"))
