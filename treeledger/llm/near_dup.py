"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive words; its weight is term frequency times inverse document frequency, kept as
a logarithmic level. Samples are banded; candidates are verified by weighted Jaccard similarity;
classes are the connected components of the verified links.

Exact copies (equal words) are one text from the start. In each bucket every text is first compared with
the bucket's leader, and what is then outside of the class of the text with most links with up to LEADERS texts
of that class. The texts of buckets that still hold several classes meet in a second, exact way: a prefix filter.
Texts of similarity t overlap in t of the heavier text's weight and 2t / (1 + t) of the lighter one's, so
they share a shingle that is among the rarest (1 - t) of the former and (1 - t) / (1 + t) of the latter; only
texts of different classes that do are compared. Thus no link is lost, no pairs are made within a class, and
texts that merely share frequent passages do not meet.

Before sets are compared, one byte of each sample is: pairs with too few equal bytes for the threshold are not
sent the sets. At the threshold's similarity at most LOSS of the pairs are lost by that (at 0.8: fewer than 33 of
70), which is some millionths of what banding itself does not find.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

SHINGLE = 5
THRESHOLD = 0.8
#: BANDS x ROWS samples: similarity 0.8 meets in some band with probability 0.996, 0.85 with 0.9997.
BANDS, ROWS = 14, 5
#: Document frequencies are counted in a sketch of so many cells, less the mean load of a cell. Its size is
#: fixed, and so is what is broadcast (one byte per cell).
CELL_BITS = 20
#: The sketch is added up in so many blocks, and so many sums at a time.
BLOCKS, FAN = 16, 64
#: Texts of a bucket that those of other classes are compared with.
LEADERS = 8
#: Share of the links at the threshold that the comparison of samples may lose, and least share that banding finds.
LOSS, FOUND = 1e-9, 0.99
#: Levels per doubling of a weight, levels that there can be, and those that samplers have a table for.
PER_DOUBLING, LEVELS, TABLE_LEVELS = 16, 1024, 40
#: A shingle that no other document has weighs more than one that all have by this share. In a group of
#: thousands of near copies what they share is frequent and what sets them apart is rare, so a larger share
#: would push copies of plain similarity over 0.8 below it.
IDF_SHARE = 0.5
_SEED = 20240229


def shingles(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of a text, ascending, and their counts. A text of fewer words than a
    shingle, but not none, has one shingle of all its words."""
    h = C.word_hashes(data)
    if not len(h):
        return h, np.zeros(0, np.int64)
    w = C.window_hashes(h, min(SHINGLE, len(h)))
    return np.unique(w, return_counts=True)


def likely(threshold: float) -> int:
    """Least number of equal samples (by one byte each) of a pair that is verified: the most that loses no more
    than LOSS of the pairs of the threshold's similarity. A threshold that the bands are not made for is an error."""
    if not 1 - (1 - threshold**ROWS) ** BANDS >= FOUND or threshold > 1:
        raise ValueError(f"{BANDS} bands of {ROWS} do not find {FOUND} of the pairs at threshold {threshold}")
    n, lost, least = BANDS * ROWS, 0.0, 0
    while least < n:
        lost += comb(n, least) * threshold**least * (1 - threshold) ** (n - least)
        if lost > LOSS:
            break
        least += 1
    return least


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def idf_levels(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Level of the smoothed inverse document frequency of each cell:
    1 + IDF_SHARE * log((N + 1) / (df + 1)) / log(N + 2), in levels."""
    load = df.sum() / len(df)
    est = np.clip(df - load, 1, max(1, n_docs))
    idf = 1 + IDF_SHARE * np.log((n_docs + 1) / (est + 1)) / np.log(n_docs + 2)
    return np.round(PER_DOUBLING * np.log2(idf)).astype(np.uint8)


@lru_cache(1)
def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Variates r, c and beta, and ln a for each of the first TABLE_LEVELS levels (10 MB, once per process)."""
    rng = np.random.Generator(np.random.PCG64(_SEED))
    size = 1 << 16
    r, c, beta = rng.gamma(2.0, 1.0, size), rng.gamma(2.0, 1.0, size), rng.random(size)
    ln_a = np.empty((TABLE_LEVELS, size), np.float32)
    for level in range(TABLE_LEVELS):
        ln_a[level] = _ln_a(r, c, beta, level)
    return r, c, beta, ln_a


C.keeps("near", _variates.cache_clear)


def _steps(r, beta, level):
    """The quantised place t of a weight of this level."""
    return np.floor(level * (np.log(2) / PER_DOUBLING) / r + beta)


def _ln_a(r, c, beta, level):
    return np.log(c) - r * (_steps(r, beta, level) - beta) - r


class Sampler:
    """Consistent weighted samples. The variates of a shingle for sample k are drawn from a table by a hash of
    both; for low levels another table holds ready values of ln a."""

    def __init__(self, idf: np.ndarray, bands: int = BANDS, rows: int = ROWS):
        self.idf, self.bands, self.rows = idf, bands, rows
        self.r, self.c, self.beta, self.ln_a = _variates()
        rng = np.random.Generator(np.random.PCG64(_SEED + 1))
        self.odd = (rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * 2 + 1).astype(np.uint32)

    def levels(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        tf = np.round(PER_DOUBLING * np.log2(counts)).astype(np.int64)
        return tf + self.idf[_cells(h)]

    def band_hashes(self, h: np.ndarray, levels: np.ndarray, block: int = 4096) -> tuple[np.ndarray, bytes]:
        """One 64-bit hash per band, and one byte of each sample."""
        flat, best = self.ln_a.reshape(-1), None
        low = (h >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(h), block):
            place = ((low[None, at : at + block] * self.odd[:, None]) >> np.uint32(16)).astype(np.int64)
            level = levels[at : at + block]
            a = flat[place + (np.minimum(level, TABLE_LEVELS - 1) << 16)[None]]
            if len(high := np.flatnonzero(level >= TABLE_LEVELS)):
                p = place[:, high]
                a[:, high] = _ln_a(self.r[p], self.c[p], self.beta[p], level[high][None])
            k = a.argmin(1)
            rows = np.arange(len(k))
            value, where, k = a[rows, k], place[rows, k], k + at
            if best is None:
                best, win, at_win = value, k, where
            else:
                better = value < best
                best, win, at_win = np.where(better, value, best), np.where(better, k, win), np.where(better, where, at_win)
        t = _steps(self.r[at_win], self.beta[at_win], levels[win]).astype(np.int64)
        s = C.mix(h[win] ^ (t.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for x in s.reshape(self.bands, self.rows).T:
            out = C.mix(out * np.uint64(0xD1342543DE82EF95) + x)
        return out, (s >> np.uint64(56)).astype(np.uint8).tobytes()


def weighted_jaccard(a: bytes, la: bytes, b: bytes, lb: bytes) -> float:
    """Of two packed sets: ascending shingle hashes (u8 each, as stored) with levels (u2 each)."""
    ha, hb = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    wa, wb = _WEIGHTS[np.frombuffer(la, "<u2")], _WEIGHTS[np.frombuffer(lb, "<u2")]
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    low = np.minimum(wa[both], wb[at[both]]).sum()
    return float(low / (wa.sum() + wb.sum() - low))


_WEIGHTS = 2.0 ** (np.arange(LEVELS) / PER_DOUBLING)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(C.words(data)), digest_size=16).digest()


# --- Spark ----------------------------------------------------------------------------------------------


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Sketch of shingle document frequencies over all documents, and the number of documents. Each task sums its
    rows in the sketch's cells; sums of FAN tasks at a time are added up, block by block of the sketch, until one
    is left, so that no task holds more than FAN sums of a block."""

    def count(batches):
        C.begin("near")
        cells, n = np.zeros(1 << CELL_BITS, np.int64), 0
        for batch in batches:
            for part in C.sub_batches(batch, "t"):
                found = [_cells(shingles(t)[0]) for t in C.texts(part, "t")]
                n += len(found)
                if found:
                    cells += np.bincount(np.concatenate(found), minlength=len(cells))
        if n:
            blocks, task = cells.reshape(BLOCKS, -1), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"block": np.arange(BLOCKS, dtype="i4"), "task": np.full(BLOCKS, task, "i4"), "n": [n] + [0] * (BLOCKS - 1), "cells": [_pack(b) for b in blocks]})

    def add(key, table):
        total = np.zeros((1 << CELL_BITS) // BLOCKS, np.int64)
        for c in table["cells"]:
            total += _unpack(c.as_py())
        return pa.table({"block": [key[0].as_py()], "task": [key[1].as_py()], "n": [sum(table["n"].to_pylist())], "cells": [_pack(total)]}, schema=pa.schema([("block", pa.int32()), ("task", pa.int32()), ("n", pa.int64()), ("cells", pa.binary())]))

    schema = "block int, task int, n long, cells binary"
    sums = C.materialize(rows.select("t").mapInArrow(count, schema), "shingle-cells")
    while sums.agg(F.max("task")).first()[0]:
        more = C.materialize(sums.withColumn("task", (F.col("task") / FAN).cast("int")).groupBy("block", "task").applyInArrow(add, schema), "shingle-cells")
        C.drop(sums)
        sums = more
    got = sorted(sums.collect(), key=lambda r: r.block)  # 2^CELL_BITS cells
    C.drop(sums)
    if not got:
        return np.zeros(1 << CELL_BITS, np.int64), 0
    return np.concatenate([_unpack(bytes(r.cells)) for r in got]), sum(r.n for r in got)


def _pack(cells: np.ndarray) -> bytes:
    return zlib.compress(cells.astype("<i8").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i8")


def _signatures(rows: DataFrame, idf) -> DataFrame:
    """(_id, _text, digest, bands, sketch) of every text with words."""
    schema = pa.schema([("_id", pa.int64()), ("_text", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int8()))])

    def run(batches):
        C.begin("near")
        sampler = Sampler(idf.value)
        for batch in batches:
            for part in C.sub_batches(batch, "t"):
                at, digests, bands, sketches = [], [], [], []
                for k, t in enumerate(C.texts(part, "t")):
                    h, n = shingles(t)
                    if len(h):
                        at.append(k)
                        digests.append(_digest(t))
                        keys, sketch = sampler.band_hashes(h, sampler.levels(h, n))
                        bands.append(keys.view(np.int64))
                        sketches.append(np.frombuffer(sketch, np.int8))
                rows_at = pa.array(at, pa.int64())
                flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * BANDS), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows_at), part.column(1).take(rows_at), pa.array(digests, pa.binary()), lists, pa.array(sketches, pa.list_(pa.int8()))], schema=schema)

    return rows.mapInArrow(run, "_id long, _text long, digest binary, bands array<long>, sketch array<tinyint>")


def _sets(rows: DataFrame, idf) -> DataFrame:
    """(digest, hashes, levels) of candidate texts; rows have digest and t."""

    def run(batches):
        C.begin("near")
        sampler = Sampler(idf.value)
        for batch in batches:
            for part in C.sub_batches(batch, "t", 1 << 20):
                hashes, levels = [], []
                for t in C.texts(part, "t"):
                    h, n = shingles(t)
                    hashes.append(h.astype("<u8").tobytes())
                    levels.append(sampler.levels(h, n).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes, pa.binary()), pa.array(levels, pa.binary())], names=["digest", "h", "l"])

    return rows.select("digest", "t").mapInArrow(run, "digest binary, h binary, l binary")


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of at least the threshold's similarity. A text that is in many pairs is to be an a: pairs
    meet its set while they are small, and what they then carry is dealt out by b."""
    left = sets.select(F.col("digest").alias("a"), F.col("h").alias("ha"), F.col("l").alias("la"))
    right = sets.select(F.col("digest").alias("b"), F.col("h").alias("hb"), F.col("l").alias("lb"))

    def run(batches):
        C.begin("near")
        for batch in batches:
            for part in C.sub_batches(batch, ("ha", "la", "hb", "lb")):
                keep = [weighted_jaccard(*(x.as_py() for x in row)) >= threshold for row in zip(*part.columns[2:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "la", "hb", "lb").mapInArrow(run, "a binary, b binary")


def _agree(a: str, b: str, least: int):
    """Whether two sketches agree in so many samples."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) >= least


def _prefixes(sets: DataFrame, rarity, threshold: float) -> DataFrame:
    """(shingle, digest, short, w, rest): the rarest shingles of each text that make up more than
    1 - threshold of its weight w, each with the weight from it on; short are those that make up more than
    (1 - threshold) / (1 + threshold). Any order that all texts share is right; the sketch puts shingles of
    frequent passages last."""

    def run(batches):
        C.begin("near")
        order = rarity.value
        for batch in (part for big in batches for part in C.sub_batches(big, ("h", "l"))):
            names, found, short, weights, rest = [], [np.zeros(0, np.int64)], [], [], [np.zeros(0)]
            for d, h, lv in zip(*(c.to_pylist() for c in batch.columns)):
                h, w = np.frombuffer(h, "<u8"), _WEIGHTS[np.frombuffer(lv, "<u2")]
                by = np.lexsort((h, order[_cells(h)]))
                total = np.cumsum(w[by])
                ends = [min(len(h), int(np.searchsorted(total, share * total[-1] * (1 + 1e-9), "right")) + 1) for share in ((1 - threshold) / (1 + threshold), 1 - threshold)]
                names += [d] * ends[1]
                weights += [float(total[-1])] * ends[1]
                short += [True] * ends[0] + [False] * (ends[1] - ends[0])
                found.append(h[by[: ends[1]]].view(np.int64))
                rest.append(total[-1] - total[: ends[1]] + w[by[: ends[1]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(names, pa.binary()), pa.array(short, pa.bool_()), pa.array(weights, pa.float64()), pa.array(np.concatenate(rest))], names=["shingle", "digest", "short", "w", "rest"])

    return sets.select("digest", "h", "l").mapInArrow(run, "shingle long, digest binary, short boolean, w double, rest double")


def connected(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for the nodes that have links. In each round every
    node takes the smallest node around it, itself among them, and then that node's choice; links are drawn
    between the choices, without loops and repeats, until none is left. A round reads each link twice and then
    keeps one row per node. All joins are between plain exchanges, so that AQE can split a node with many
    links. ``links`` is a stored table and stays; tables of former rounds are deleted."""
    edges, labels = links, None
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("e")).select("e.*")
        up = C.materialize(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
        far = C.materialize(up.join(up.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").select("node", F.col("far").alias("label")), "labels")
        old, labels = labels, far if labels is None else relabelled(labels, far)
        a, b = far.toDF("a", "la"), far.toDF("b", "lb")
        rest = edges.join(a, "a").join(b, "b").where("la != lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
        rest = C.materialize(rest.distinct(), "near-rest")
        C.drop(up, *([edges] if edges is not links else []), *([old, far] if old is not None else []))
        edges = rest
        if edges.isEmpty():
            C.drop(edges)
            return labels


def relabelled(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels (node, label) after the labels themselves got labels, where they did."""
    joined = labels.join(more.toDF("label", "far"), "label", "left")
    return C.materialize(joined.select("node", F.coalesce("far", "label").alias("label")), "labels")


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(_id, _text, class_id, class_size, keep) of every document with words, _text being xxhash64 of the text.

    ``class_id`` is the smallest id of the class, ``keep`` marks the class's first row by (id, _text), nulls
    last. Null texts and texts without words are classes of their own (their own id) and not returned; repeated
    rows are copies of each other; ids that are all null give a null class_id. Ids are whole numbers (long).
    Thresholds below about 0.78 are an error. Tables that hold intermediate results are deleted.

    No text is shuffled but those that share a bucket: the others are told apart by a key filter.
    """
    least = likely(threshold)
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("_text"), F.coalesce(text, F.lit("")).alias("t"))
    df, n = document_frequencies(rows)
    idf = spark.sparkContext.broadcast(idf_levels(df, n))
    rarity = spark.sparkContext.broadcast(np.minimum(255, 8 * np.log2(df + 1)).astype(np.uint8))
    signed = C.materialize(_signatures(rows, idf), "near-signatures")

    # Texts, and of these the ones that share a bucket with another; the hash of a bucket holds its band.
    reps = signed.groupBy("digest").agg(F.min_by(F.struct("_id", "_text"), F.struct(F.col("_id").isNull(), "_id", "_text")).alias("at"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = C.materialize(reps, "near-texts")
    members = reps.select("digest", "sketch", F.col("at._id").alias("_i"), F.col("at._text").alias("_x"), F.explode("bands").alias("bucket"))
    crowded = C.materialize(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "near-buckets")
    places = C.materialize(C.KeyFilter(crowded, "bucket").among(members, "bucket").join(crowded, "bucket").select("bucket", "digest", "sketch", "_i", "_x"), "near-places")
    wanted = C.materialize(places.groupBy("digest").agg(F.first("_i").alias("_i"), F.first("_x").alias("_x"), F.first("sketch").alias("sketch")), "near-wanted")
    C.drop(reps, crowded)
    same_row = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_x"))
    found = C.KeyFilter(wanted, "_i", "_x").among(rows, "_id", "_text").join(wanted.drop("sketch"), same_row)
    sets = C.materialize(_sets(found.select("digest", "t"), idf), "near-sets")
    if sets.count() > wanted.count():  # repeated rows
        sets, old = C.materialize(sets.dropDuplicates(["digest"]), "near-sets"), sets
        C.drop(old)

    def links_of(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, sa, b, sb) of texts with their sketches."""
        return C.materialize(_verify(pairs.where(_agree("sa", "sb", least)).select("a", "b").distinct(), sets, threshold), "near-links")

    def with_label(labels: DataFrame) -> DataFrame:
        return C.materialize(places.select("bucket", "digest", "sketch").join(labels.toDF("digest", "label"), "digest"), "near-named")

    def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels after links between texts of different labels."""
        a, b = labels.toDF("a", "la"), labels.toDF("b", "lb")
        across = links.join(a, "a").join(b, "b").where("la != lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
        across = C.materialize(across.distinct(), "near-across")
        far = connected(across)
        out = relabelled(labels, far)
        C.drop(across, far, labels)
        return out

    leaders = places.groupBy("bucket").agg(F.min(F.struct("digest", "sketch")).alias("leader"))
    pairs = places.join(leaders, "bucket").where("digest != leader.digest")
    links = links_of(pairs.select(F.col("leader.digest").alias("a"), F.col("leader.sketch").alias("sa"), F.col("digest").alias("b"), F.col("sketch").alias("sb")))
    far = connected(links)
    labels = C.materialize(wanted.select("digest").join(far.toDF("digest", "label"), "digest", "left").select(F.col("digest").alias("node"), F.coalesce("label", "digest").alias("label")), "labels")
    C.drop(far)

    # Buckets of several classes: the others meet the text with most links and some texts of its class.
    degrees = links.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count("*").alias("degree"))
    named = with_label(labels)
    who = F.struct("digest", "sketch", "label")
    picks = [F.min_by(who, F.xxhash64("digest", F.lit(k))) for k in range(LEADERS - 1)]
    heads = named.join(degrees, "digest", "left").groupBy("bucket").agg(F.max_by(who, F.struct(F.coalesce("degree", F.lit(0)), "digest")).alias("top"), F.array(*picks).alias("picks"), F.min("label").alias("low"), F.max("label").alias("high"))
    heads = heads.where("low != high").select("bucket", F.col("top.label").alias("main"), F.expr("filter(array_distinct(concat(array(top), picks)), h -> h.label = top.label)").alias("heads"))
    heads = C.materialize(heads, "near-heads")
    met = named.join(heads, "bucket").where("label != main").select("digest", "sketch", F.explode("heads").alias("head"))
    more = links_of(met.select(F.col("head.digest").alias("a"), F.col("head.sketch").alias("sa"), F.col("digest").alias("b"), F.col("sketch").alias("sb")))
    if not more.isEmpty():
        labels = merged(labels, more)
    C.drop(links, more, named, heads)

    # What then still is in buckets of several classes: texts of different classes that share a rare shingle.
    named = with_label(labels)
    still = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket")
    texts = C.materialize(named.select("bucket", "digest", "label").join(still, "bucket").select("digest", "label").distinct(), "near-rest-texts")
    C.drop(places, named)
    some_sets = C.KeyFilter(texts, "digest").among(sets, "digest")
    rare = _prefixes(some_sets.join(texts.select("digest"), "digest"), rarity, threshold)
    rare = C.materialize(rare.join(texts, "digest").select("shingle", "digest", "label", "short", "w", "rest"), "near-rare")
    met = rare.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("short").alias("any")).where("low != high and any").select("shingle")
    rare_met = C.materialize(rare.join(met, "shingle").select("shingle", "digest", "label", "short", "w", "rest"), "near-rare-met")
    C.drop(texts, rare)
    # At the first shingle of both, what is left of either must hold the overlap that the threshold asks for:
    # the other text weighs at most ``room``. Classes, then texts, then pairs are held to this.
    rare = rare_met.withColumn("room", F.col("rest") / (threshold / (1 + threshold) * (1 - 1e-9)) - F.col("w"))
    short = [F.min(F.when(F.col("short"), F.col("w"))).alias("least"), F.max(F.when(F.col("short"), F.col("room"))).alias("own_room")]
    sides = rare.groupBy("shingle", "label").agg(F.max("short").alias("short"), *short, F.min("w").alias("lightest"), F.max("w").alias("heaviest"), F.max("room").alias("widest"))
    sides = C.materialize(sides, "near-sides")
    other = sides.select("shingle", F.col("label").alias("other"), "lightest", "heaviest", "widest")
    across = sides.where("short").select("shingle", "label", "least", "own_room").join(other, "shingle")
    across = across.where("label != other and least <= heaviest and least <= widest and lightest <= own_room").drop("least", "own_room")
    left = rare.where("short").select(F.col("shingle").alias("_s"), F.col("label").alias("_l"), F.col("digest").alias("p"), F.col("w").alias("wp"), F.col("room").alias("room_p"))
    right = rare.select(F.col("shingle").alias("_t"), F.col("label").alias("_o"), F.col("digest").alias("q"), F.col("w").alias("wq"), F.col("room").alias("room_q"))
    some = F.expr("wp <= heaviest and wp <= widest and lightest <= room_p")
    last = across.join(left, (F.col("shingle") == F.col("_s")) & (F.col("label") == F.col("_l")) & some).select("_s", "other", "p", "wp", "room_p")
    last = last.join(right, (F.col("_s") == F.col("_t")) & (F.col("other") == F.col("_o")) & F.expr("wp <= wq and wq <= room_p and wp <= room_q"))
    a, b = (wanted.select(F.col("digest").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    last = links_of(last.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct().join(a, "a").join(b, "b"))
    if not last.isEmpty():
        labels = merged(labels, last)
    C.drop(last, rare_met, sides, sets, wanted)

    named = signed.select("_id", "_text", "digest").join(labels.toDF("digest", "label"), "digest", "left").select("_id", "_text", F.coalesce("label", "digest").alias("label"))
    members = C.materialize(named, "near-members")
    C.drop(signed, labels)
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_text")
    heads = members.groupBy("label").agg(F.min(order).alias("head"), F.count("*").alias("class_size"))
    out = members.join(heads, "label").select("_id", "_text", F.col("head._id").alias("class_id"), "class_size", (order == F.col("head")).alias("keep"))
    out = C.materialize(out, "near-classes")
    C.drop(members)
    return out


def assign(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Add class_id, class_size and keep to documents (columns of these names are replaced); see ``classes``."""
    df = C.without(docs, ["class_id", "class_size", "keep"])
    found = classes(docs, doc_id=doc_id, text=text, **options).distinct().withColumnsRenamed({"_id": "_i", "_text": "_x"})
    keyed = df.withColumn("_text", F.coalesce(F.xxhash64(text), F.lit(0)))
    joined = keyed.join(found, F.col(doc_id).cast("long").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_x")), "left").drop("_i", "_x", "_text")
    alone = F.col("keep").isNull()
    return joined.withColumns({"class_id": F.when(alone, F.col(doc_id).cast("long")).otherwise(F.col("class_id")), "class_size": F.coalesce("class_size", F.lit(1)), "keep": F.coalesce("keep", F.lit(True))})


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, with its own columns. Of repeated rows that are a class's first, one
    stays; texts without words all stay. Only rows that may be in a class of several are shuffled."""
    plain, restore = C.stow(docs, ["class_id", "class_size", "keep"])
    found = classes(docs, doc_id=doc_id, text=text, **options)
    several = found.where("class_size > 1").select(F.col("_id").alias("_i"), F.col("_text").alias("_x"), "keep").distinct()
    keyed = plain.withColumns({"_own": F.col(doc_id).cast("long"), "_text": F.coalesce(F.xxhash64(text), F.lit(0))})
    told = C.KeyFilter(several, "_i", "_x")
    joined = told.among(keyed, "_own", "_text").join(several, F.col("_own").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_x")), "left")
    firsts = joined.where("keep").dropDuplicates(["_own", "_text"])
    out = told.others(keyed, "_own", "_text").unionByName(joined.where("keep is null").select(*keyed.columns)).unionByName(firsts.select(*keyed.columns))
    return restore(out)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, keep."""
    return assign(docs.select("doc_id", "text")).drop("text")
