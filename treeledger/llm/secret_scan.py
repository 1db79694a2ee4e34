"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags tokens as begin,
inside or outside of a secret and adds its spans: values that the patterns miss, and within an assignment the
value alone.

The field's features are the token's shape, its neighbours' shapes and words, and features of the whole
text. It is fitted on windows of a sample of the documents, tagged by the patterns. So that it learns more than
the patterns, the values are also moved into quiet windows, bare or behind other words about credentials, and
so are made-up values of other alphabets; things that only look alike (dates, versions, names with numbers,
words about credentials in prose) are put into other windows, as outside. A token is outside for certain where its own score exceeds all that transitions could gain; exact
Viterbi decoding then runs only on the stretches between such tokens.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

KINDS = ["assign", "access", "hex", "crf"]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_BYTES = re.compile(rb"[0-9a-f]{24}").search
_KEYS = (b"passw", b"secret", b"token", b"api")
#: The field is fitted on windows of about this many documents, chosen by a hash of their id and text.
SAMPLE = 3000
#: Windows of so many tokens; of the sample's windows with and without a secret so many at most, chosen by a hash.
WINDOW, TAGGED, QUIET = 24, 2000, 5000
STEPS, RATE, L2 = 60, 0.15, 1e-4
#: A span of the field counts from so many characters.
LEAST = 6
#: Tokens up to this length are remembered with their features.
REMEMBERED = 64
O, B, I = 0, 1, 2  # noqa: E741


def base_spans(text: str, data: bytes) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns: (kind, start, end) in code points, by start and then kind."""
    out = []
    low = data.lower()
    if any(k in low for k in _KEYS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in data:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    if _HEX_BYTES(data):
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def join_spans(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- tokens and features ---------------------------------------------------------------------------

_TOKEN = re.compile(r"[\w+/-]+|[^\s\w+/-]")
_WORDS = frozenset("password passwd pwd secret token api apikey api_key key keys auth bearer authorization access access_key credential credentials login private signature".split())


def signature(token: str) -> str:
    """What the field sees of a token: its shape, or itself for signs and words about credentials."""
    n = len(token)
    if token.isalpha():
        low = token.lower()
        if low in _WORDS:
            return "w:" + low
        kind = "l" if token == low else "u" if token == token.upper() else "t" if token[1:] == low[1:] else "m"
        return f"a:{kind}:{min(n.bit_length(), 6)}"
    if n == 1 and not token.isalnum():
        return "p:" + token
    low = token.lower()
    if low in _WORDS:
        return "w:" + low
    kinds = token.translate(_KIND) if token.isascii() else "".join(["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s" for c in token])
    changes = len(_RUN.findall(kinds)) - 1
    digits = kinds.count("d")
    is_hex = _ALL_HEX(token) is not None
    return f"x:{''.join(sorted(set(kinds)))}:{min(n.bit_length(), 7)}:{int(is_hex)}:{4 * digits // n}:{min(changes.bit_length(), 4)}:{'k' if any(w in low for w in ('key', 'pass', 'tok')) else ''}"


_KIND = {c: "d" if chr(c).isdigit() else "l" if chr(c).islower() else "u" if chr(c).isupper() else "s" for c in range(128)}
_RUN = re.compile(r"d+|l+|u+|s+")
_ALL_HEX = re.compile(r"[0-9a-fA-F]+").fullmatch


def _parts(sig: str) -> list[str]:
    """A signature's features: itself, and each of its fields."""
    fields = sig.split(":")
    return [sig] + [f"{fields[0]}{i}:{x}" for i, x in enumerate(fields[1:])] if fields[0] in "ax" else [sig]


ROLES = (0, -1, -2, 1)


def file_features(text: str, tokens: int) -> list[str]:
    n = max(1, len(text))
    digits = sum(text.count(c) for c in "0123456789") / n
    signs = sum(text.count(c) for c in "=:\"'{};") / n
    return [f"f:digits:{int(min(4, 40 * digits))}", f"f:signs:{int(min(4, 40 * signs))}", f"f:size:{min(tokens.bit_length(), 12)}"]


class Field:
    """A fitted field: weights per feature and role, and transitions."""

    def __init__(self, weights: dict[str, np.ndarray], trans: np.ndarray, start: np.ndarray):
        self.weights, self.trans, self.start = weights, trans, start
        gain = -np.inf
        before, after = np.vstack([trans, start]), np.vstack([trans.T, np.zeros(3)])
        for x in (B, I):
            gain = max(gain, float((before[:, x] - before[:, O]).max() + (after[:, x] - after[:, O]).max()))
        self.bound = gain
        self.place: dict[str, int] = {}
        self.table = np.zeros((4096, len(ROLES), 3), np.float32)
        self.known: dict[str, int] = {}

    def __getstate__(self):
        return self.weights, self.trans, self.start

    def __setstate__(self, state):
        self.__init__(*state)

    def _index(self, token: str) -> int:
        sig = signature(token)
        k = self.place.get(sig)
        if k is None:
            k = self.place[sig] = len(self.place)
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for r, role in enumerate(ROLES):
                for f in _parts(sig):
                    w = self.weights.get(f"{role}|{f}")
                    if w is not None:
                        self.table[k, r] += w
        if len(token) <= REMEMBERED:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = k
        return k

    def emissions(self, text: str, tokens: list[str]) -> np.ndarray:
        get, index = self.known.get, self._index
        at = np.fromiter([k if (k := get(t)) is not None else index(t) for t in tokens], np.int64, len(tokens))
        e = self.table[at, 0]
        for r, role in enumerate(ROLES[1:], 1):
            if role < 0:
                e[-role:] += self.table[at[:role], r]
            else:
                e[:-role] += self.table[at[role:], r]
        for f in file_features(text, len(tokens)):
            w = self.weights.get(f)
            if w is not None:
                e += w.astype(np.float32)
        return e

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best tags (exact Viterbi)."""
        tags = np.zeros(len(e), np.int8)
        open_ = np.flatnonzero(e[:, O] - np.maximum(e[:, B], e[:, I]) <= self.bound)
        if not len(open_):
            return tags
        cut = np.flatnonzero(np.diff(open_) > 1) + 1
        for run in np.split(open_, cut):
            a, b = int(run[0]), int(run[-1]) + 1
            tags[a:b] = self._viterbi(e[a:b].astype(float), self.start if a == 0 else self.trans[O], b < len(e))
        return tags

    def _viterbi(self, e: np.ndarray, first: np.ndarray, closed: bool) -> list[int]:
        t = self.trans.tolist()
        score, back = (first + e[0]).tolist(), []
        for row in e[1:].tolist():
            new, come = [], []
            for y in range(3):
                x = max(range(3), key=lambda s: score[s] + t[s][y])
                new.append(score[x] + t[x][y] + row[y])
                come.append(x)
            score = new
            back.append(come)
        if closed:
            score = [s + t[x][O] for x, s in enumerate(score)]
        y = max(range(3), key=lambda s: score[s])
        out = [y]
        for come in reversed(back):
            y = come[y]
            out.append(y)
        return out[::-1]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        tokens = _TOKEN.findall(text)
        if not tokens:
            return []
        tags = self.decode(self.emissions(text, tokens))
        if not tags.any():
            return []
        out, at, start, end = [], 0, None, 0
        for tok, tag in zip(tokens, tags.tolist()):
            at = text.index(tok, at)
            if tag != I and start is not None:
                out.append(("crf", start, end))
                start = None
            if tag == B or tag == I and start is None:
                start = at
            at += len(tok)
            if tag != O:
                end = at
        if start is not None:
            out.append(("crf", start, end))
        return [s for s in out if s[2] - s[1] >= LEAST]


# --- fitting ----------------------------------------------------------------------------------------


def _labelled(text: str) -> tuple[list[str], np.ndarray]:
    """Tokens, and tags by the patterns' matches (of assignments: the value)."""
    data = text.encode()
    inside = [(m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    inside += [s[1:] for s in base_spans(text, data) if s[0] != "assign"]
    inside.sort()
    found = list(_TOKEN.finditer(text))
    tags, k, last = np.zeros(len(found), np.int8), 0, None
    for i, m in enumerate(found):
        while k < len(inside) and inside[k][1] <= m.start():
            k += 1
        if k < len(inside) and inside[k][0] < m.end():
            tags[i] = I if last == k and i and tags[i - 1] else B
            last = k
    return [m.group() for m in found], tags


#: Words that made-up contexts use, and what may stand between such a word and a value.
_CONTEXTS = "pwd key keys auth bearer authorization access access_key credential credentials private apikey secret token password".split()
_BETWEEN = [[], [":"], ["="], ["is"], [":", '"'], ["=", '"'], ["-", ">"], ["was", "set", "to"]]
_PROSE = "reset policy garden of for and was expired holder economy service the must be".split()


def windows_of(text: str) -> list[tuple[bool, int, str]]:
    """(with a secret, first token, JSON of signatures with two before and one behind, tags, file features)."""
    tokens, tags = _labelled(text)
    whole, hot = file_features(text, len(tokens)), np.flatnonzero(tags)
    starts = {(True, max(0, int(h) - o) // 6 * 6) for h in hot for o in (6, 16)}
    starts |= {(False, k) for k in range(0, len(tokens), 7 * WINDOW) if not tags[k : k + WINDOW].any()}
    out = []
    for tagged, k in sorted(starts):
        sigs = [signature(tokens[i]) if 0 <= i < len(tokens) else "" for i in range(k - 2, k + WINDOW + 1)]
        out.append((tagged, k, json.dumps([sigs, tags[k : k + WINDOW].tolist(), whole])))
    return out


def _made_up(rng) -> str:
    """A value of one of several alphabets."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = [letters + "0123456789", letters.upper() + "0123456789", letters + letters.upper() + "0123456789", letters + letters.upper() + "0123456789+/", "0123456789abcdef", "0123456789ABCDEF", letters + letters.upper() + "0123456789_-"]
    alphabet, n = kinds[int(rng.integers(len(kinds)))], int(rng.integers(16, 65))
    return "".join(alphabet[int(k)] for k in rng.integers(0, len(alphabet), n))


def _look_alike(rng) -> list[str]:
    """Tokens that are no secret."""
    n, word = int(rng.integers(1, 10_000)), "abdegilmnorstu"
    name = "".join(word[int(k)] for k in rng.integers(0, len(word), int(rng.integers(4, 12))))
    kinds = [f"{name}{n}", f"{name.upper()}_{n}", f"{name.title()}{name.title()}", f"20{n % 100:02d}-{n % 12 + 1:02d}-{n % 28 + 1:02d}", f"v{n % 10}.{n % 7}.{n}", str(n * 7919 * 104729), f"{name}@mail{n % 9}.example.com", f"{name}/{name}/{n}", f"{name}-{name}-{name}", f"{n % 256}.{n % 251}.{n % 241}.{n % 239}", f"+{n % 99} {n} {n * 31}"]
    if rng.random() < 0.3:
        return [_CONTEXTS[int(rng.integers(len(_CONTEXTS)))], _PROSE[int(rng.integers(len(_PROSE)))], _PROSE[int(rng.integers(len(_PROSE)))]]
    return _TOKEN.findall(kinds[int(rng.integers(len(kinds)))])


def _put(window, at: int, sigs: list[str], tags: list[int]):
    """A window with other tokens from a place on; the window's own follow them."""
    own, marks, whole = window
    own, marks = own[: at + 2] + sigs + own[at + 2 :], marks[:at] + tags + marks[at:]
    return own[: WINDOW + 3], marks[:WINDOW], whole


def more_windows(tagged: list, quiet: list) -> list:
    """Quiet windows with values moved into them, with made-up values, and with things that look alike."""
    rng, out = np.random.default_rng(7), []
    values = []
    for sigs, tags, _ in tagged:
        for k, t in enumerate(tags):
            if t == B:
                e = k + 1
                while e < len(tags) and tags[e] == I:
                    e += 1
                values.append(sigs[k + 2 : e + 2])
    for k, w in enumerate(quiet[: len(quiet) // 4 * 3]):
        if len(w[1]) < 4:
            continue
        at = int(rng.integers(0, len(w[1])))
        if k % 3 == 2:
            own = [signature(t) for t in _look_alike(rng)]
            out.append(_put(w, at, own, [O] * len(own)))
            continue
        value = values[int(rng.integers(len(values)))] if values and k % 3 else [signature(t) for t in _TOKEN.findall(_made_up(rng))]
        before: list[str] = []
        if rng.random() < 0.7:
            before = [signature(t) for t in [_CONTEXTS[int(rng.integers(len(_CONTEXTS)))], *_BETWEEN[int(rng.integers(len(_BETWEEN)))]]]
        elif not any(s.split(":")[2] >= "5" for s in value if s.startswith("x:")):
            continue  # short ones are no secret without a word about it
        out.append(_put(w, at, before + value, [O] * len(before) + [B] + [I] * (len(value) - 1)))
    return out


def fit(sample: list[str]) -> Field:
    """Fit on whole texts."""
    found = [w for t in sample for w in windows_of(t)]
    return fit_windows([json.loads(w) for hot, _, w in found if hot], [json.loads(w) for hot, _, w in found if not hot])


def fit_windows(tagged: list, quiet: list) -> Field:
    """Maximum likelihood on windows (gradient ascent with Adam); deterministic. Without any window with a
    secret, made-up values alone are learned; without any window, nothing is a secret."""
    windows = tagged + more_windows(tagged, quiet) + quiet
    names: dict[str, int] = {}
    if not windows:
        return Field({"0|": np.zeros(3)}, np.zeros((3, 3)), np.array([60.0, 0, 0]))
    lists, y = [], np.full((len(windows), WINDOW), -1, np.int8)
    for n, (sigs, tags, whole) in enumerate(windows):
        for i, tag in enumerate(tags):
            y[n, i] = tag
            feats = list(whole)
            for role in ROLES:
                if (sig := sigs[i + role + 2] if i + role + 2 < len(sigs) else ""):
                    feats += [f"{role}|{f}" for f in _parts(sig)]
            lists.append((n * WINDOW + i, [names.setdefault(f, len(names)) for f in feats]))
    row = np.repeat([r for r, _ in lists], [len(f) for _, f in lists])
    col = np.concatenate([f for _, f in lists])
    par, n = np.zeros(3 * len(names) + 9), len(windows)
    m1, m2 = np.zeros_like(par), np.zeros_like(par)
    for k in range(1, STEPS + 1):
        grad = gradient(par, row, col, y)[1] / n - L2 * par
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        par = par + RATE * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    w, trans = par[:-9].reshape(-1, 3), par[-9:].reshape(3, 3)
    return Field({f: w[k] for f, k in names.items()}, trans, trans[O].copy())


def gradient(par: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood and its gradient. ``par``: weights (feature, tag), then transitions; feature ``col`` is on
    at place ``row`` of the windows; ``y``: tags of the windows' places, -1 behind a window's end."""
    n, size = y.shape
    w, trans = par[:-9].reshape(-1, 3), par[-9:].reshape(3, 3)
    mask = y >= 0
    both = mask[:, 1:] & mask[:, :-1]
    e = np.stack([np.bincount(row, w[col, c], minlength=n * size) for c in range(3)], 1).reshape(n, size, 3)
    t, top = np.exp(trans), e.max(2, keepdims=True)
    pot = np.exp(e - top)
    pot[~mask] = 1
    alpha, beta = np.empty_like(pot), np.ones_like(pot)
    norm = pot[:, 0].sum(1)
    total = np.log(norm) * mask[:, 0]
    alpha[:, 0] = pot[:, 0] / norm[:, None]
    for i in range(1, size):
        a = (alpha[:, i - 1] @ t) * pot[:, i]
        norm = a.sum(1)
        alpha[:, i] = a / norm[:, None]
        total += np.log(norm) * mask[:, i]
    pair = np.zeros((3, 3))
    for i in range(size - 2, -1, -1):
        nxt = pot[:, i + 1] * beta[:, i + 1] * mask[:, i + 1, None] + ~mask[:, i + 1, None]
        b = np.where(mask[:, i + 1, None], nxt @ t.T, 1.0)
        beta[:, i] = b / b.sum(1, keepdims=True)
        joint = alpha[:, i, :, None] * t[None] * nxt[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        pair += joint[both[:, i]].sum(0)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    onehot = (y[..., None] == np.arange(3)).astype(float)
    real = np.zeros((3, 3))
    np.add.at(real, (y[:, :-1][both], y[:, 1:][both]), 1)
    value = float((e * onehot).sum() + (trans * real).sum() - total.sum() - (top[..., 0] * mask).sum())
    gap = ((onehot - post) * mask[..., None]).reshape(-1, 3)
    own = np.stack([np.bincount(col, gap[row, c], minlength=len(w)) for c in range(3)], 1)
    return value, np.concatenate([own.ravel(), (real - pair).ravel()])


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Field:
    """Fit the field on windows of a sample of about ``sample`` documents, tagged by the patterns' matches. Of
    their windows at most TAGGED and QUIET come to the driver, as signatures (about 1 kB each), the ones with the
    smallest hashes of their document and place."""
    n = docs.count()
    rows = docs.select(F.xxhash64(doc_id, text).alias("h"), F.col(text).alias("t")).where("t is not null")
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))

    def cut(batches):
        C.begin("secrets")
        for batch in batches:
            for part in C.sub_batches(batch, "t"):
                for h, t in zip(part.column(0).to_pylist(), C.texts(part, "t")):
                    found = windows_of(t.decode())
                    yield pa.RecordBatch.from_arrays([pa.array([h] * len(found), pa.int64()), pa.array([x[0] for x in found], pa.bool_()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.string())], names=["h", "hot", "at", "w"])

    found = C.materialize(rows.mapInArrow(cut, "h long, hot boolean, at long, w string"), "secret-windows")
    got = [[json.loads(r.w) for r in found.where(F.col("hot") == hot).orderBy(F.xxhash64("h", "at"), "w").limit(most).collect()] for hot, most in ((True, TAGGED), (False, QUIET))]
    C.drop(found)
    return fit_windows(*got)


# --- Spark --------------------------------------------------------------------------------------------


def scan(docs: DataFrame, field: Field, *, text: str = "text") -> DataFrame:
    """Add ``secrets``: an array of (kind, start, end) by start and then kind, with starts and ends in code
    points. Spans of the patterns always stay; the field adds its own, less those that a pattern has exactly.

    Null and empty texts have no secrets; repeated rows get equal spans; a column named ``secrets`` is
    replaced, all others pass. No shuffle."""
    df = C.without(docs, ["secrets"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = df.limit(0).withColumn("secrets", F.lit(None).cast("array<struct<kind:string,start:long,end:long>>")).schema
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        C.begin("secrets")
        model = shared.value
        for batch in batches:
            for part in C.sub_batches(batch, text):
                found = [[{"kind": k, "start": a, "end": b} for k, a, b in all_spans(t, model)] for t in C.texts(part, text)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], names=[*part.schema.names, "secrets"])

    return df.mapInArrow(run, schema)


def all_spans(data: bytes, field: Field) -> list[tuple[str, int, int]]:
    text = data.decode()
    base = base_spans(text, data)
    held = {b[1:] for b in base}
    more = [s for s in field.spans(text) if s[1:] not in held]
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(docs: DataFrame, field: Field, *, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """Replace every span by ``mark``; null texts stay null, and other columns stay as they are."""
    plain, restore = C.stow(docs, ["secrets"])
    found = scan(plain, field, text=text)

    def cut(batches):
        C.begin("secrets")
        for batch in batches:
            k, spans = batch.schema.get_field_index(text), batch.column(batch.schema.get_field_index("secrets")).to_pylist()
            new = []
            for t, s in zip(batch.column(k).to_pylist(), spans):
                for x in reversed(_merged(s)) if t else []:
                    t = t[: x[0]] + mark + t[x[1] :]
                new.append(t)
            yield batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))

    return restore(found.mapInArrow(cut, found.schema))


def _merged(spans: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for s in sorted((x["start"], x["end"]) for x in spans):
        if out and s[0] < out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return out


def digest_row(spans: list[tuple[str, int, int]]) -> tuple[int, int, int, str, str]:
    base = [s for s in spans if s[0] != "crf"]
    n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
    return *n, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs.select("doc_id", "text"), train(docs))
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), C.sha256_hex(line(base)).alias("base_sha256"), line(F.col("secrets")).alias("spans"))
