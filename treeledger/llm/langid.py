"""Language identification by multilingual mixture inference.

A language is a distribution over hashed byte trigrams, counted over all learning documents. A document is
a mixture: expectation-maximisation estimates its language proportions from the trigram likelihoods, and
the set of its languages is the nested set of the most probable ones with the best penalised likelihood.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

BINS = 8192
#: A model is BINS floats per language; a table that names more languages is refused, not cut.
MOST_LANGUAGES = 4096
#: Overlapping trigrams are not independent: log-likelihoods count by this share.
EVIDENCE = 1 / 3
ITERATIONS, TOLERANCE = 25, 1e-3
UNKNOWN = "und"
_LETTERS = np.full(256, 32, np.uint32)
for _a, _b in ((65, 91), (97, 123), (128, 256)):
    _LETTERS[_a:_b] = np.arange(_a, _b)
_LETTERS[65:91] += 32
_ASCII_LETTER = re.compile(rb"[A-Za-z]").search


def has_letter(data: bytes) -> bool:
    return bool(_ASCII_LETTER(data)) or (not data.isascii() and any(c.isalpha() for c in data.decode("utf-8", "replace")))


def trigram_counts(data: bytes, block: int = 1 << 20) -> np.ndarray:
    """Counts of the hashed trigrams around every letter of the whole text; anything else is a blank."""
    out = np.zeros(BINS, np.int64)
    for at in range(0, len(data), block):
        a = _LETTERS[np.frombuffer(data[max(0, at - 1) : at + block + 1], np.uint8)]
        if not at:
            a = np.concatenate([[np.uint32(32)], a])
        if at + block >= len(data):
            a = np.concatenate([a, [np.uint32(32)]])
        code = (a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA77) ^ a[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        out += np.bincount(code[a[1:-1] != 32] >> np.uint32(19), minlength=BINS)
    return out


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: languages x BINS."""
        self.langs = langs
        if not langs:
            return
        counts = counts.astype(np.float64) + 0.0
        background = (counts.sum(0) + 1) / (counts.sum() + BINS)
        own = (counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * BINS)
        self.p = (0.98 * own + 0.02 * background).astype(np.float64)

    def _em(self, p: np.ndarray, c: np.ndarray, n: float) -> tuple[np.ndarray, float]:
        theta = np.full(len(p), 1 / len(p))
        if len(p) == 1:
            return theta, float(c @ np.log(p[0]))
        for _ in range(ITERATIONS):
            new = theta * (p @ (c / (theta @ p))) / n
            moved, theta = np.abs(new - theta).max(), new
            if moved < TOLERANCE:
                break
        return theta, float(c @ np.log(theta @ p))

    def mixture(self, data: bytes) -> list[tuple[str, float]]:
        """The document's languages with their proportions, largest first; none without letters."""
        if not self.langs or not has_letter(data):
            return []
        counts = trigram_counts(data)
        at = np.flatnonzero(counts)
        c = counts[at].astype(np.float64)
        n = c.sum()
        p = self.p[:, at]
        theta, _ = self._em(p, c, n)
        order = np.argsort(-theta, kind="stable")
        best, found = -np.inf, None
        for k in range(1, len(order) + 1):
            t, likelihood = self._em(p[order[:k]], c, n)
            value = EVIDENCE * likelihood - 0.5 * (k - 1) * np.log(n + 1) - 3.0 * (k - 1)
            if value <= best:
                break
            best, found = value, t
        return sorted(((self.langs[order[i]], float(found[i])) for i in range(len(found))), key=lambda x: (-x[1], x[0]))


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> Model:
    """Count the trigrams of every row with a language. Tasks send sums per language and bin."""

    def count(batches):
        C.begin("languages")
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in C.sub_batches(batch, "t"):
                for t, x in zip(C.texts(part, "t"), part.column(1).to_pylist()):
                    sums[x] = sums.get(x, 0) + trigram_counts(t)
        for x, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_pydict({"lang": [x] * len(at), "bin": at.astype("i4"), "n": v[at]})

    rows = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("t is not null and l is not null")
    sums = rows.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = C.materialize(sums, "langid-counts")
    langs = [r.lang for r in table.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs.sort()
    counts = np.zeros((len(langs), BINS), np.int64)
    place = {x: i for i, x in enumerate(langs)}
    for r in table.toLocalIterator():
        counts[place[r.lang], r.bin] = r.n
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Add lang_pred, score (the proportion of that language) and languages (all of the chosen set).

    Null texts and texts without letters are ``und`` with score 0 and no languages, as is everything if
    nothing was learned. Ties go to the smaller name. Columns of these names are replaced."""
    added = ["lang_pred", "score", "languages"]
    df = C.without(docs, added)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    schema = df.limit(0).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "languages": F.lit(None).cast("array<struct<lang:string,share:double>>")}).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        C.begin("languages")
        m = shared.value
        for batch in batches:
            for part in C.sub_batches(batch, text):
                found = [m.mixture(t) for t in C.texts(part, text)]
                arrays = [pa.array([x[0][0] if x else UNKNOWN for x in found]), pa.array([min(1.0, x[0][1]) if x else 0.0 for x in found], pa.float64()), pa.array([[{"lang": a, "share": b} for a, b in x] for x in found], kind)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *added])

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents that are not held out."""
    model = learn(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
