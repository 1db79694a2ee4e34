"""SentencePiece encoding and decoding: the N best segmentations of a text over its piece lattice.

Forward Viterbi scores of the lattice are exact heuristics for a backward A-star search. A lattice falls
apart at places that no piece crosses (before a word mark, around a line feed, between a letter and a full
stop or comma), so the forward pass runs once per distinct stretch, vectorised over many, with the two best
scores of each. The N best of a text can differ from its best segmentation only in the N - 1 stretches of
the smallest gap between these two; the A-star search runs in those, and once more over their results.

Scores are the model file's; its settings for normalising text are not used: a word mark is put first, blanks
become word marks, and all else stays. A character without a piece is spelled by its UTF-8 bytes as one edge.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

N_BEST = 3
MARK = "▁"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_LONG = 48
_NONE = -1e18
#: Stretches that each of two generations of a worker's memory holds (about 300 bytes each), lists of segmentations
#: that it holds, and places of stretches that are looked up at a time.
MOST, MOST_LISTS, CELLS = 75_000, 20_000, 1 << 15


class Pieces:
    """The vocabulary of a SentencePiece model as a lattice builder, encoder and decoder."""

    def __init__(self, path: str, most: int = MOST):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.bytes_id, self.piece, self.spelling, self.score = {}, {}, [b""] * size, [0.0] * size
        lowest = 0.0
        for i, p in enumerate(names):
            if model.is_byte(i):
                self.bytes_id[int(p[3:-1], 16)] = i
                self.spelling[i] = bytes([int(p[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[i] = model.get_score(i)
                self.piece[p] = (i, self.score[i])
                self.spelling[i] = p.replace(MARK, " ").encode()
                lowest = min(lowest, model.get_score(i))
        if len(self.bytes_id) != 256:
            raise ValueError("the model has no byte pieces")
        self.unknown = lowest - 10
        self.longest = max(map(len, self.piece))
        crossing = any(re.search(rf"[{_LETTER}][.,]", p) for p in self.piece) or any("\n" in p for p in self.piece) or any(MARK in p.lstrip(MARK) for p in self.piece)
        if crossing:
            self.chunk = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+") if not any(MARK in p.lstrip(MARK) for p in self.piece) else re.compile(r"(?s).+")
        else:
            self.chunk = re.compile(rf"{MARK}*[{_LETTER}]++(?=[.,{MARK}\n]|\Z)|\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        self._build()
        self.most, self.new, self.old, self.lists = most, {}, {}, {}

    # The forward pass: substrings of many stretches are looked up by hashes of their code points.

    def _build(self):
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.longest, self.base, np.uint64)]))
        by_length: dict[int, list[tuple[int, int, float]]] = {}
        for p, (i, s) in self.piece.items():
            h = int((C.mix(np.array([ord(c) for c in p], np.uint64) + np.uint64(1)) * self.powers[: len(p)]).sum(dtype=np.uint64))
            by_length.setdefault(len(p), []).append((h, i, s))
        self.tables = {}
        for n, rows in by_length.items():
            rows.sort()
            h = np.array([r[0] for r in rows], np.uint64)
            if len(np.unique(h)) < len(h):
                raise ValueError("hashes of pieces collide")
            bits = max(8, int(np.ceil(np.log2(len(h)))) + 3)
            first = np.searchsorted(h >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64)).astype(np.int64)
            deepest = int(np.bincount((h >> np.uint64(64 - bits)).astype(np.int64)).max())
            pad = np.concatenate([h, np.zeros(deepest, np.uint64)])
            self.tables[n] = (np.uint64(64 - bits), first, deepest, pad, np.array([r[1] for r in rows] + [-1] * deepest), np.array([r[2] for r in rows] + [_NONE] * deepest))

    def _look_up(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and scores of substrings of length n by their hashes."""
        shift, first, deepest, keys, ids, scores = self.tables[n]
        at = first[(h >> shift).view(np.int64)]
        place = np.where(keys[at] == h, at, len(ids) - 1)
        for d in range(1, deepest):
            place = np.where(keys[at + d] == h, at + d, place)
        return ids[place], scores[place]

    def _forward_many(self, stretches: list[str]):
        """Best ids, best score and gap to the second best of stretches of at most _LONG code points."""
        w, t = len(stretches), max(map(len, stretches))
        code = np.zeros((w, t), np.uint64)
        lengths = np.array([len(s) for s in stretches])
        flat = np.frombuffer("".join(stretches).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        inside = np.arange(t)[None] < lengths[:, None]
        code[inside] = C.mix(flat)
        best, second = np.full((t + 1, w), _NONE), np.full((t + 1, w), _NONE)
        best[0] = 0
        step, piece = np.zeros((t + 1, w), np.int8), np.full((t + 1, w), -1, np.int64)
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        h = np.zeros((w, t), np.uint64)
        for n in range(1, min(self.longest, t) + 1):
            h = h[:, : t - n + 1] + code[:, n - 1 :] * self.powers[n - 1]
            if n in self.tables:
                ids, scores = self._look_up(n, h)
                if n == 1:
                    scores = np.where(ids < 0, self.unknown, scores)
                if n == 1 or (ids >= 0).any():
                    found[n] = (ids.T.copy(), scores.T.copy())
        for e in range(1, t + 1):
            for n in sorted(found, reverse=True):
                if n > e:
                    continue
                ids, scores = found[n]
                s = scores[e - n]
                one, two = best[e - n] + s, second[e - n] + s
                better = one > best[e]
                second[e] = np.maximum(np.maximum(second[e], two), np.where(better, best[e], one))
                best[e] = np.where(better, one, best[e])
                step[e] = np.where(better, n, step[e])
                piece[e] = np.where(better, ids[e - n], piece[e])
        cols, at, parts = np.arange(w), lengths.copy(), []
        while at.any():
            p = piece[at, cols]
            parts.append(np.where(at > 0, p, -2))
            at = at - step[at, cols]
        table = np.array(parts[::-1]).T if parts else np.zeros((w, 0), np.int64)
        own = table != -2
        buffer = table[own].astype("<u4").tobytes()
        ends = 4 * np.cumsum(own.sum(1))
        a, b = best[lengths, cols], second[lengths, cols]
        gaps = np.where(b > _NONE / 2, a - b, np.inf).tolist()
        start = 0
        for s, end, score, gap in zip(stretches, ends.tolist(), a.tolist(), gaps):
            yield s, (buffer[start:end], score, gap)
            start = end
        for k in np.flatnonzero((table == -1).any(1)).tolist():
            row = table[k]
            yield stretches[k], (self._spell(stretches[k], row[row != -2]).astype("<u4").tobytes(), float(a[k]), gaps[k])

    def _spell(self, s: str, row: np.ndarray) -> np.ndarray:
        out, at = [], 0
        for i in row.tolist():
            if i < 0:
                out += [self.bytes_id[b] for b in s[at].encode()]
                at += 1
            else:
                out.append(i)
                at += len(self.spelling[i].decode())
        return np.array(out)

    def steps(self, s: str, end: int) -> list[tuple[int, int, float]]:
        """The lattice's edges that end at a place, longest first: (id or -1, length, score)."""
        get, out = self.piece.get, []
        for n in range(min(self.longest, end), 0, -1):
            p = get(s[end - n : end])
            if p is not None:
                out.append((p[0], n, p[1]))
        if not out or out[-1][1] > 1:
            out.append((-1, 1, self.unknown))
        return out

    def forward(self, s: str) -> array:
        """Forward Viterbi scores of all places of a stretch."""
        best, steps = array("d", [0.0]), self.steps
        for e in range(1, len(s) + 1):
            best.append(max([best[e - n] + score for _, n, score in steps(s, e)]))
        return best

    def n_best_of(self, s: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a stretch: backward A-star from its end, with the forward scores as
        heuristic, which are exact, so that an entry's rank is what its path loses against the best one.

        An entry stands for one edge at one place, the edges of a place being in the order of their loss; taking
        it brings the place's next edge and the first edge of the place it leads to. A place is gone on from n
        times at most, as a worse way to it is in none of the n best. So time and memory are linear in the length
        of the stretch. Equal scores come by the longer last pieces first."""
        key = (s, n)
        if key in self.lists:
            return self.lists[key]
        best, out, seen, serial = self.forward(s), [], {}, 0
        heap: list = [(0.0, 0, len(s), 0, None)]
        while heap and len(out) < n:
            lost, _, at, rank, path = heapq.heappop(heap)
            edges = sorted([(best[at] - best[at - m] - score, -m, i) for i, m, score in self.steps(s, at)])
            own, m, i = edges[rank]
            if rank + 1 < len(edges):
                serial -= 1
                heapq.heappush(heap, (lost - own + edges[rank + 1][0], serial, at, rank + 1, path))
            to, path = at + m, (i, -m, path)
            if to:
                if seen.get(to, 0) < n:
                    seen[to] = seen.get(to, 0) + 1
                    serial -= 1
                    heapq.heappush(heap, (lost, serial, to, 0, path))
                continue
            ids, start, total = [], 0, 0.0
            while path:
                i, m, path = path
                ids += [i] if i >= 0 else [self.bytes_id[b] for b in s[start].encode()]
                total += self.score[i] if i >= 0 else self.unknown
                start += m
            out.append((total, ids))
        if len(self.lists) > MOST_LISTS:
            self.lists.clear()
        if len(s) <= _LONG:
            self.lists[key] = out
        return out

    def learn(self, stretches: set[str]):
        """Bring the forward results of stretches into the cache (two generations of bounded size)."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        missing, old, fresh = stretches.difference(self.new), self.old, []
        for s in missing:
            v = old.get(s)
            if v is not None:
                self.new[s] = v
            elif len(s) <= _LONG:
                fresh.append(s)
        fresh.sort(key=len, reverse=True)
        k = 0
        while k < len(fresh):
            many = max(1, CELLS // len(fresh[k]))
            self.new.update(self._forward_many(fresh[k : k + many]))
            k += many

    def _long(self, s: str):
        """A long stretch, without the memory: a forward pass with the two best scores."""
        best, second = array("d", [0.0]), array("d", [_NONE])
        back, width, steps = array("q", [0]), array("q", [0]), self.steps
        for e in range(1, len(s) + 1):
            one = two = _NONE
            for i, n, score in steps(s, e):
                a, b = best[e - n] + score, second[e - n] + score
                if a > one:
                    one, two, i_best, n_best = a, max(two, b, one), i, n
                else:
                    two = max(two, a, b)
            best.append(one)
            second.append(two)
            back.append(i_best)
            width.append(n_best)
        ids, at = [], len(s)
        while at:
            i = back[at]
            ids += [i] if i >= 0 else [self.bytes_id[b] for b in reversed(s[at - 1].encode())]
            at -= width[at]
        return np.array(ids[::-1], "<u4").tobytes(), best[-1], best[-1] - second[-1] if second[-1] > _NONE / 2 else np.inf

    def stretches(self, text: str) -> list[str]:
        return self.chunk.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, parts: list[str], n: int) -> tuple[np.ndarray, list[float], list[list[tuple[int, int, np.ndarray]]]]:
        """For the stretches of a text, all in the cache or long: the best ids, the scores of the n best
        segmentations, and for each of these what it puts in the place of best ids: (start, end, other ids)."""
        get = self.new.get
        if not parts:
            return np.zeros(0, "<u4"), [0.0], [[]]
        found = list(map(get, parts))
        if None in found:
            found = [v or self._long(s) for v, s in zip(found, parts)]
        spelled, own, gaps = zip(*found)
        ids, total = np.frombuffer(b"".join(spelled), "<u4"), float(sum(own))
        gaps, near = np.array(gaps), []
        while len(near) < n - 1 and np.isfinite(gaps[k := int(gaps.argmin())]):
            near.append(k)
            gaps[k] = np.inf
        near.sort()
        lists = [self._after(np.frombuffer(spelled[i], "<u4").tolist(), self.n_best_of(parts[i], n)) for i in near]
        starts = [sum(map(len, spelled[:i])) // 4 for i in near]
        places = [(at, at + len(spelled[i]) // 4) for at, i in zip(starts, near)]
        heap, seen, scores, changes = [(0.0, (0,) * len(near))], {(0,) * len(near)}, [], []
        while heap and len(scores) < n:
            lost, pick = heapq.heappop(heap)
            scores.append(total - lost)
            changes.append([(*places[k], np.array(lists[k][p][1], "<u4")) for k, p in enumerate(pick) if p])
            for k in range(len(near)):
                p = pick[:k] + (pick[k] + 1,) + pick[k + 1 :]
                if p[k] < len(lists[k]) and p not in seen:
                    seen.add(p)
                    heapq.heappush(heap, (sum(lists[j][0][0] - lists[j][q][0] for j, q in enumerate(p)), p))
        return ids, scores, changes

    @staticmethod
    def _after(best: list[int], found: list[tuple[float, list[int]]]) -> list[tuple[float, list[int]]]:
        """The n best of a stretch with the forward pass's best ids first, where equal scores order otherwise."""
        if found[0][1] == best:
            return found
        return [(found[0][0], best), *(x for x in found if x[1] != best)][: len(found)]

    @staticmethod
    def change(ids: np.ndarray, changes: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
        """The ids of a segmentation from the best ids and its changes."""
        out, at = [], 0
        for start, end, other in changes:
            out += [ids[at:start], other]
            at = end
        return np.concatenate([*out, ids[at:]]) if out else ids

    def n_best(self, text: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text, best first: (score, ids)."""
        parts = self.stretches(text)
        self.learn(set(parts))
        ids, scores, changes = self.encode(parts, n)
        return [(s, self.change(ids, c).tolist()) for s, c in zip(scores, changes)]

    def spell(self, ids) -> bytes:
        spelling = self.spelling
        return b"".join([spelling[i] for i in ids])

    def decode(self, ids) -> bytes:
        """The UTF-8 text of ids; the leading mark that encoding added is taken off."""
        return self.spell(ids).removeprefix(b" ")

    def round_trip(self, text: bytes, ids: np.ndarray, changes) -> bool:
        """Whether all segmentations decode to the text, word marks read as blanks: the best one as a whole,
        the others where they differ from it."""
        whole = self.decode(ids.tolist()) == text.replace(MARK.encode(), b" ")
        return whole and all(self.spell(other.tolist()) == self.spell(ids[a:b].tolist()) for c in changes for a, b, other in c)


_loaded: dict[str, Pieces] = {}
C.keeps("pieces", _loaded.clear)


def pieces(path: str) -> Pieces:
    """One vocabulary per worker process, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _offsets(lists) -> pa.Array:
    return pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(_offsets(ids), pa.array(np.concatenate([np.zeros(0, np.int32), *(i.astype(np.int32) for i in ids)])))


def encode(docs: DataFrame, model: str, *, text: str = "text", n: int = N_BEST, with_ids: bool = True) -> DataFrame:
    """Add n_pieces, scores (of the n best segmentations, best first), ids_crc32 (of the best ids as
    little-endian unsigned 32-bit integers), decoded (whether decoding each of the n gives the text back,
    word marks read as blanks), n_pieces_each and ids_crc32_each (of the n, best first) and with ``with_ids``
    the best ids and segmentations, the n best as (score, ids).

    Null and empty texts have no pieces, the one score 0 and decode to the empty text. Repeated rows are
    encoded each. Columns of these names are replaced, all others pass. No shuffle."""
    added = ["n_pieces", "scores", "ids_crc32", "decoded", "n_pieces_each", "ids_crc32_each"] + ["ids", "segmentations"] * with_ids
    df = C.without(docs, [*added, "ids", "segmentations"])
    cols = {"n_pieces": F.lit(0).cast("long"), "scores": F.lit(None).cast("array<double>"), "ids_crc32": F.lit(0).cast("long"), "decoded": F.lit(True)}
    cols |= {c: F.lit(None).cast("array<long>") for c in ("n_pieces_each", "ids_crc32_each")}
    if with_ids:
        cols |= {"ids": F.lit(None).cast("array<int>"), "segmentations": F.lit(None).cast("array<struct<score:double,ids:array<int>>>")}
    schema = df.limit(0).withColumns(cols).schema

    def run(batches):
        C.begin("pieces")
        p = pieces(model)
        for batch in batches:
            for part in C.sub_batches(batch, text, 1 << 20):
                raw = C.texts(part, text)
                parts = [p.stretches(t.decode()) for t in raw]
                p.learn(set().union(*parts))
                got = [p.encode(x, n) for x in parts]
                same = [p.round_trip(t, ids, changes) for (ids, _, changes), t in zip(got, raw)]
                each = [[p.change(ids, c) for c in changes] for ids, _, changes in got]
                sums = [[zlib.crc32(i.tobytes()) for i in x] for x in each]
                arrays = [pa.array([len(i) for i, _, _ in got], pa.int64()), pa.array([s for _, s, _ in got], pa.list_(pa.float64())), pa.array([x[0] for x in sums], pa.int64()), pa.array(same, pa.bool_())]
                arrays += [pa.array([[len(i) for i in x] for x in each], pa.list_(pa.int64())), pa.array(sums, pa.list_(pa.int64()))]
                if with_ids:
                    scores = pa.array([s for _, x, _ in got for s in x], pa.float64())
                    ranked = pa.StructArray.from_arrays([scores, _lists([i for x in each for i in x])], ["score", "ids"])
                    arrays += [_lists([i for i, _, _ in got]), pa.ListArray.from_arrays(_offsets(each), ranked)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *added])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: str, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the text that a column of ids spells, word marks as blanks; a column of this name is replaced, all
    others pass. Null ids have a null text, and no ids the empty one. Bytes that are no UTF-8 become U+FFFD;
    control ids spell nothing; an id that the model doesn't have, or a null in the array, is an error. No shuffle."""
    out = C.without(df.withColumn("_ids", F.col(ids).cast("array<int>")), [text])
    schema = C.fields(out.drop("_ids").schema, *out.limit(0).select(F.lit("").cast("string").alias(text)).schema)
    schema[text].nullable = True

    def run(batches):
        C.begin("pieces")
        p = pieces(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part, found = batch.slice(k, 64), []
                at = part.schema.get_field_index("_ids")
                for x in part.column(at):
                    own = x.as_py()
                    if own and (None in own or min(own) < 0 or max(own) >= len(p.spelling)):
                        raise ValueError("an id is not in the model")
                    found.append(None if own is None else p.decode(own).decode(errors="replace"))
                arrays, names = list(part.columns), list(part.schema.names)
                del arrays[at], names[at]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, pa.string())], names=[*names, text])

    return out.mapInArrow(run, schema)


def report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, scores, ids_crc32, decoded, n_pieces_each, ids_crc32_each."""
    return encode(docs.select("doc_id", "text"), model, with_ids=False).drop("text")
