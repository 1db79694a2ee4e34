"""Benchmark decontamination.

Normalised n-grams of the benchmark form a hash set that is broadcast in blocks of bounded size; every
document is scanned once per block, hashed hits are verified word by word, and the hit spans or whole
documents can be removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

WINDOW = 10
#: Windows in one broadcast block (about 250 bytes each). A larger benchmark is scanned in several blocks.
BLOCK_WINDOWS = 400_000
_ADDED = ["n_words", "hit_spans", "items"]


class _Index:
    """Windows of one block of items: for each length a hash filter and the exact windows."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int):
        self.windows: dict[int, dict[bytes, list[str | None]]] = {}
        for item, text in rows:
            w = C.words(text)
            n = min(window, len(w))
            if not n:
                continue
            of = self.windows.setdefault(n, {})
            for i in range(len(w) - n + 1):
                ids = of.setdefault(b" ".join(w[i : i + n]), [])
                if not ids or ids[-1] != item:
                    ids.append(item)
        self.filter = {n: _table(np.concatenate([C.window_hashes(C.word_hashes(k), n) for k in of])) for n, of in self.windows.items()}

    def scan(self, text: bytes, hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs of words [start, end) and the items with windows in the text."""
        hit, items, w = [], set(), None
        for n, (bits, keys) in self.filter.items():
            h = C.window_hashes(hashes, n)
            at = np.flatnonzero(bits[h >> np.uint64(44)])
            if not len(at):
                continue
            place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            at = at[keys[place] == h[at]]
            if not len(at):
                continue
            w = C.words(text) if w is None else w
            exact = self.windows[n]
            for i in at.tolist():
                found = exact.get(b" ".join(w[i : i + n]))
                if found:
                    hit.append((i, i + n))
                    items.update(i for i in found if i is not None)
        return _union(hit), items


_held: dict[str, _Index] = {}
C.keeps("benchmark", _held.clear)


def _index(key: str, shared, window: int) -> _Index:
    """One index per worker process, kept between the tasks of a block."""
    if key not in _held:
        _held.clear()
        _held[key] = _Index(shared.value, window)
    return _held[key]


def _table(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.zeros(1 << 20, bool)
    bits[h >> np.uint64(44)] = True
    return bits, np.unique(h)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, window: int, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of about ``most`` windows (word counts are an upper bound of windows)."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("t"))
    total = rows.agg(F.sum(F.length("t") / 2 + 1)).first()[0] or 0
    n = int(total // most) + 1
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r.i, bytes(r.t)) for r in part.distinct().collect()]


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Annotate documents with ``n_words``, ``hit_spans`` (merged runs of word indices [start, end)) and
    ``items`` (sorted ids of the items with occurring windows).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
    window. Null and empty texts have no words and no hits; items without words hit nothing; the windows of an
    item with a null id hit as any other's, but the item is in no list; repeated rows are annotated each; an empty benchmark hits nothing. Columns that bear the
    added names are replaced, all others pass. Only narrow work: documents are never shuffled.
    """
    df = C.without(docs, _ADDED)
    df = df.withColumns({"n_words": F.lit(None).cast("long"), "hit_spans": F.array().cast("array<struct<start:long,end:long>>"), "items": F.array().cast("array<string>")})
    spark = docs.sparkSession
    for rows in _blocks(benchmark, item_id, item_text, window, block_windows):
        shared = spark.sparkContext.broadcast(rows)

        def scan_part(batches, shared=shared, key=uuid.uuid4().hex):
            C.begin("benchmark")
            index = _index(key, shared, window)
            for big in batches:
                for batch in C.sub_batches(big, text):
                    yield _scan_batch(index, batch, text)

        df = df.mapInArrow(scan_part, df.schema)
    return df


def _scan_batch(index: _Index, batch: pa.RecordBatch, text: str) -> pa.RecordBatch:
    names = batch.schema.names
    old_spans, old_items = (batch.column(names.index(c)).to_pylist() for c in ("hit_spans", "items"))
    counts, spans, items = [], [], []
    for t, s, i in zip(C.texts(batch, text), old_spans, old_items):
        h = C.word_hashes(t)
        hit, found = index.scan(t, h)
        if s:
            hit = _union(hit + [(x["start"], x["end"]) for x in s])
        counts.append(len(h))
        spans.append([{"start": a, "end": b} for a, b in hit])
        items.append(sorted(found.union(i)))
    arrays = list(batch.columns)
    for name, values in (("n_words", counts), ("hit_spans", spans), ("items", items)):
        k = names.index(name)
        arrays[k] = pa.array(values, batch.schema.field(k).type)
    return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Cut runs of words out of a text, from the first word's start to the last word's end."""
    if not spans:
        return text
    at = [m.span() for m in C.WORD.finditer(text.lower())]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, text[done:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, action: str = "documents", text: str = "text", **options) -> DataFrame:
    """Remove what ``scan`` hits: ``action="documents"`` drops every document with a hit;
    ``action="spans"`` cuts the hit words out of the text and keeps all rows. Columns stay as they were;
    the cases of ``scan`` hold (a null text is kept as null)."""
    if action not in ("documents", "spans"):
        raise ValueError("action is documents or spans")
    plain, restore = C.stow(docs, _ADDED)
    hit = scan(plain, benchmark, text=text, **options)
    if action == "documents":
        return restore(hit.where(F.size("hit_spans") == 0))

    def cut(batches):
        C.begin("benchmark")
        for big in batches:
            for b in C.sub_batches(big, text):
                k, s = b.schema.get_field_index(text), b.column(b.schema.get_field_index("hit_spans")).to_pylist()
                valid = b.column(k).is_valid().to_pylist()
                new = [remove_spans(t, [(x["start"], x["end"]) for x in y]).decode() if v else None for t, y, v in zip(C.texts(b, text), s, valid)]
                yield b.set_column(k, b.schema.field(k), pa.array(new, b.schema.field(k).type))

    return restore(hit.mapInArrow(cut, hit.schema))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = scan(docs.select("doc_id", "text"), benchmark, **options)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return hit.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        C.sha256_hex(F.array_join("items", ",")).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: DuckDB SQL for ``report``.
REPORT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n.n, k, array_to_string(w[k : k + n.n - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d) x, n WHERE k + n.n - 1 <= len(w)),
h AS (SELECT dw.r, dw.k, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
p AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS q FROM (SELECT DISTINCT r, k, n FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.r = d.r LEFT JOIN t ON t.r = d.r
"""
