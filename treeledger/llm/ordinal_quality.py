"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector over hashed text features for all grades and
ordered thresholds theta. The model gives the expected grade and tail probabilities for selection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Grades: 0 toxic, 1 poor, 2 good.
GRADES = 3
GOOD = 2
#: The classifier is fitted on about this many rated documents at most, chosen by a hash of their id.
SAMPLE = 20_000
BITS = 18
_SHAPES = 128
LEAST_DF = 4
STEPS, RATE, L2 = 120, 0.08, 2e-4
#: Shape buckets weigh as so many words.
SHAPE_SCALE = 8.0
#: A document is selected if P(grade >= GOOD) reaches this.
SELECT = 0.6


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The graded rating of a label row; null where the ratings are unknown."""
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 2)


def _bucket(x: float) -> int:
    """0 for 0, then buckets of the logarithm of a ratio from 1/512 to 1."""
    return 0 if x <= 0 else int(min(9, max(1, 10 + np.log2(min(1.0, x)))))


_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in "#*$%&<>"]] = 1
_CLASS[ord("|")] = 2
_CLASS[ord("!")] = 3
_CLASS[65:91] = 4
_CLASS[97:123] = 5
_CLASS[48:58] = 6


def features(data: bytes) -> np.ndarray:
    """Indices of the features of a text: its distinct hashed words, and shape buckets."""
    h = C.word_hashes(data)
    known = np.zeros(8, np.int64)
    for at in range(0, len(data), 1 << 20):
        known += np.bincount(_CLASS[np.frombuffer(data, np.uint8, min(1 << 20, len(data) - at), at)], minlength=8)
    n, chars = len(h), max(1, len(data))
    own = np.unique((h >> np.uint64(64 - BITS)).astype(np.uint32))
    letters = max(1, known[4] + known[5])
    again = float((h[1:] == h[:-1]).sum()) / n if n else 0.0
    shape = [
        int(min(15, np.log2(n + 1))),
        16 + _bucket(known[1] / chars),
        26 + _bucket(known[2] / chars),
        36 + _bucket(known[3] / chars),
        46 + int(10 * known[4] / letters),
        57 + _bucket(known[6] / chars),
        67 + _bucket(again),
        77 + int(10 * len(own) / n if n else 11),
    ]
    return np.concatenate([own, np.array(shape, np.uint32) + np.uint32(1 << BITS)])


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, data: bytes) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        s = float(self.weights[features(data)].sum())
        return 1 / (1 + np.exp(np.clip(self.thresholds - s, -60, 60)))


def fit(rows: list[tuple[np.ndarray, int]], grades: int = GRADES) -> Model:
    """Full-batch Adam on the ordinal likelihood. Thresholds are a first value and positive steps, so they
    stay ordered. Without rows every document has the top grade."""
    size = (1 << BITS) + _SHAPES
    if not rows:
        return Model(np.zeros(size, np.float32), np.full(grades - 1, -4.0) + np.arange(grades - 1) * 0.1)
    y = np.array([g for _, g in rows])
    lengths = np.array([len(f) for f, _ in rows])
    at = np.concatenate([f for f, _ in rows]).astype(np.int64)
    seen = np.bincount(at, minlength=size)
    live = np.flatnonzero(seen >= LEAST_DF)
    place = np.full(size, -1)
    place[live] = np.arange(len(live))
    row, col = np.repeat(np.arange(len(rows)), lengths), place[at]
    row, col = row[col >= 0], col[col >= 0]
    scale = np.where(live >= 1 << BITS, SHAPE_SCALE, 1.0)
    counts = np.bincount(y, minlength=grades) + 0.5
    cumulative = np.cumsum(counts)[:-1] / counts.sum()
    theta = np.log(cumulative / (1 - cumulative))
    par = np.concatenate([[theta[0]], np.log(np.maximum(np.diff(theta), 1e-2))])
    w = np.zeros(len(live))
    m1, m2 = np.zeros(len(w) + len(par)), np.zeros(len(w) + len(par))
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    wide = lambda p: np.concatenate([[p[0]], p[0] + np.cumsum(np.exp(p[1:]))])
    for step in range(1, STEPS + 1):
        s = np.bincount(row, (w * scale)[col], minlength=len(rows))
        t = np.concatenate([[-60.0], wide(par), [60.0]])
        upper, lower = sig(t[y + 1] - s), sig(t[y] - s)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        ds = (dl - du) / len(rows)  # of the likelihood, by s
        grad_w = np.bincount(col, ds[row], minlength=len(w)) * scale - L2 * w
        grad_t = np.array([(du[y == k].sum() - dl[y == k + 1].sum()) for k in range(grades - 1)]) / len(rows)
        grad_p = np.concatenate([[grad_t.sum()], [grad_t[k:].sum() * np.exp(par[k]) for k in range(1, len(par))]])
        g = np.concatenate([grad_w, grad_p])
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.99 * m2 + 0.01 * g * g
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w += move[: len(w)]
        par += move[len(w) :]
    weights = np.zeros(size, np.float32)
    weights[live] = w * scale
    return Model(weights, wide(par))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the rated documents. Ratings with nulls and ratings of absent or null
    texts are not used. The sampled ids are at most some tens of thousands of rows, so they are broadcast."""
    rated = labels.select(F.col(doc_id).alias("_id"), grade().alias("_grade")).where("_id is not null and _grade is not null").distinct()
    n = rated.count()
    if n > sample:
        rated = rated.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(sample / n * (1 << 20)))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(rated.limit(2 * sample)), "_id").select("t", "_grade")

    def extract(batches):
        C.begin("quality")
        for batch in batches:
            for part in C.sub_batches(batch, "t"):
                yield pa.RecordBatch.from_arrays([pa.array([features(t).tobytes() for t in C.texts(part, "t")], pa.binary()), part.column(1).cast(pa.int32())], names=["f", "g"])

    got = rows.mapInArrow(extract, "f binary, g int").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["g"][i].as_py(), got["f"][i].as_py()))
    return fit([(np.frombuffer(got["f"][i].as_py(), np.uint32), got["g"][i].as_py()) for i in order])


def score(docs: DataFrame, model: Model, *, text: str = "text", select: float = SELECT) -> DataFrame:
    """Add expected_grade, p_good (P(grade >= GOOD)), p_not_toxic (P(grade >= 1)) and selected.

    Null and empty texts have no features but their shape and are graded like any other; repeated rows
    get equal grades. Columns of these names are replaced. No shuffle."""
    added = ["expected_grade", "p_good", "p_not_toxic", "selected"]
    df = C.without(docs, added)
    schema = df.limit(0).withColumns({"expected_grade": F.lit(0.0), "p_good": F.lit(0.0), "p_not_toxic": F.lit(0.0), "selected": F.lit(True)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        C.begin("quality")
        m = shared.value
        for batch in batches:
            for part in C.sub_batches(batch, text):
                if not part.num_rows:
                    continue
                tails = np.array([m.tails(t) for t in C.texts(part, text)])
                arrays = [pa.array(tails.sum(1)), pa.array(tails[:, GOOD - 1]), pa.array(tails[:, 0]), pa.array(tails[:, GOOD - 1] >= select)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *added])

    return df.mapInArrow(run, schema)


def select_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents whose tail probability reaches the bound, with their own columns."""
    plain, restore = C.stow(docs, ["expected_grade", "p_good", "p_not_toxic", "selected"])
    return restore(score(plain, train(docs, labels), **options).where("selected"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document: doc_id, expected_grade, p_good, p_not_toxic, selected."""
    return score(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
