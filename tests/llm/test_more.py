"""More of the text operators: foreign archives, held-out secrets, gradients, long texts, the pipeline."""

import base64
import hashlib
import io
import json
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from treeledger.llm import _common as C
from treeledger.llm import langid, line_dedup, near_dup, ordinal_quality, piece_lattice, secret_scan, token_store, warc

PROSE = "some plain words about nothing in particular , and more of them . "


# --- shared


def test_key_filter_never_misses_a_key(spark):
    C.reachable(spark)
    rows = spark.range(40000).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("a"), (F.col("id") % 3).alias("b"))
    keys = rows.where("a % 10 = 3 or a is null").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    told = C.KeyFilter(keys, "x", "y")
    hit, rest = told.among(rows, "a", "b"), told.others(rows, "a", "b")
    assert hit.count() + rest.count() == 40000 and hit.columns == rows.columns
    assert not rest.where("a % 10 = 3 or a is null").count() and hit.count() < 15000
    assert C.KeyFilter(keys.limit(0), "x", "y").among(rows, "a", "b").count() == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="checkpoint"):
        C.shared_dir(Session())


# --- pieces


def test_long_stretches_take_memory_in_proportion():
    p, peak = piece_lattice.Pieces(public_tokenizers.path("piece_bpe_32k.model")), []
    for n in (5000, 40000):
        s = base64.b64encode(np.random.default_rng(n).bytes(n)).decode()[:n]
        tracemalloc.start()
        found = p.n_best(s, 3)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len({tuple(i) for _, i in found}) == 3 and all(p.decode(i) == s.encode() for _, i in found)
        assert [x for x, _ in found] == sorted((x for x, _ in found), reverse=True)
    assert peak[1] < 12 * peak[0] and peak[1] < 40 << 20


def test_n_best_of_equal_pieces_is_exact():
    p = piece_lattice.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for s in ("aaaaaaaa", "ababab", "▁▁▁▁", "000000"):
        ways = [[]] + [None] * len(s)
        every = {0: [(0.0, ())]}
        for e in range(1, len(s) + 1):
            every[e] = [(t + score, (*ids, i)) for i, n, score in p.steps(s, e) for t, ids in every[e - n]]
        want = sorted((t for t, _ in every[len(s)]), reverse=True)[:5]
        got = p.n_best_of(s, 5)
        assert [t for t, _ in got] == want and len({tuple(i) for _, i in got}) == len(got), ways


# --- secrets


def test_base_spans_against_plain_search():
    rng = np.random.default_rng(5)
    bits = ["password", "API_KEY", "token", "=", ":", " ", '"', "'", "abc", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "é", ".", "/", "x"]
    for _ in range(300):
        t = "".join(bits[int(k)] for k in rng.integers(0, len(bits), 12))
        want, low = [], t
        for kind, pattern, group, least in (("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
            want += [(kind, *m.span()) for m in re.finditer(pattern, low, re.ASCII) if len(m.group(group)) >= least]
        assert secret_scan.base_spans(t, t.encode()) == sorted(want, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_gradient_of_the_field_against_differences():
    rng = np.random.default_rng(6)
    n, size, features = 3, 4, 5
    y = rng.integers(0, 3, (n, size)).astype(np.int8)
    y[2, 2:] = -1
    places = [k for k in range(n * size) if y.reshape(-1)[k] >= 0]
    row = np.repeat(places, 2)
    col = rng.integers(0, features, len(row))
    par = rng.normal(0, 1, 3 * features + 9)
    value, grad = secret_scan.gradient(par, row, col, y)
    for k in range(len(par)):
        step = np.zeros_like(par)
        step[k] = 1e-5
        up, down = (secret_scan.gradient(par + d, row, col, y)[0] for d in (step, -step))
        assert abs((up - down) / 2e-5 - grad[k]) < 1e-4
    assert value < 0


def test_field_finds_values_in_held_out_contexts():
    rng = np.random.default_rng(8)
    letters = list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789")
    key = lambda n: "".join(rng.choice(letters, n))
    words = "alpha beta gamma delta the of and running house water 2021 item7 mail3 a.b@c.org version".split()
    prose = lambda n: " ".join(rng.choice(words, n))
    sample = [f"{prose(40)} password={key(18).lower()} {prose(30)}" for _ in range(40)] + [prose(150) for _ in range(300)]
    field = secret_scan.fit(sample)
    hit = extra = 0
    contexts = ["use {} to log in", "Authorization: Bearer {} ,", "my login -> {}", "{}"]
    for k in range(120):
        v = key(int(rng.integers(22, 40)))
        t = f"{prose(20)} {contexts[k % 4].format(v)} {prose(20)}"
        at = t.index(v)
        found = [s for s in secret_scan.all_spans(t.encode(), field) if s[0] == "crf"]
        hit += any(a <= at and e >= at + len(v) for _, a, e in found)
        extra += sum(e <= at or a >= at + len(v) for _, a, e in found)
    assert hit >= 0.9 * 120 and extra <= 0.1 * 120
    inside = secret_scan.all_spans(f"{prose(9)} password={key(18).lower()} {prose(9)}".encode(), field)
    assert [s[0] for s in inside] == ["assign", "crf"] and inside[1][2] == inside[0][2]


def test_shapes_are_of_whole_tokens():
    assert secret_scan.signature("a1" + "b" * 400) != secret_scan.signature("a1" + "b" * 300 + "Z9" * 50)


# --- classifier, languages


def test_ordinal_model_maximises_its_likelihood():
    rng = np.random.default_rng(9)
    rows = [(np.array([int(rng.integers(0, 6)), 6 + g]), g) for g in (0, 1, 2) for _ in range(40)] + [(np.array([0, 7]), 2), (np.array([0, 7]), 0)]
    model = ordinal_quality.fit(rows)

    def loss(w, t):
        total = 0.0
        for f, g in rows:
            c = [0.0, *(1 / (1 + np.exp(-(t - w[f].sum())))), 1.0]
            total += np.log(c[g + 1] - c[g])
        return total / len(rows) - ordinal_quality.L2 / 2 * float((w**2).sum())

    best = loss(model.weights.astype(float), model.thresholds)
    for k in (0, 6, 7, 8):
        for d in (-0.3, 0.3):
            w = model.weights.astype(float)
            w[k] += d
            assert loss(w, model.thresholds) < best + 0.01  # 120 steps


def test_mixture_proportions_maximise_the_likelihood():
    rng = np.random.default_rng(10)
    counts = rng.integers(0, 50, (3, langid.BINS))
    model = langid.Model(["a", "b", "c"], counts)
    at = rng.integers(0, langid.BINS, 60)
    c = rng.integers(1, 5, 60).astype(float)
    theta, value = model._em(model.p[:, at], c, c.sum())
    for x in np.linspace(0, 1, 21):
        for y in np.linspace(0, 1 - x, 21):
            t = np.array([x, y, 1 - x - y])
            assert float(c @ np.log(np.maximum(t @ model.p[:, at], 1e-300))) <= value + 0.3  # it stops when proportions move by less than a thousandth
    assert abs(theta.sum() - 1) < 1e-9


# --- archives


def frame(kind, block, *more):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{kind}>", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"]
    return zstandard.ZstdCompressor().compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_other_writers(spark, tmp_path):
    page = b"<p>hello</p>"
    sha1 = base64.b32encode(hashlib.sha1(page).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page
    data = frame("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields")
    data += frame("response", http, "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", "WARC-Concurrent-To: <urn:a>", "WARC-Concurrent-To: <urn:b>", "WARC-Target-URI: http://e.org/", " x")
    data += b"\x53\x2a\x4d\x18\x02\x00\x00\x00zz" + frame("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http")
    (tmp_path / "a.warc.zst").write_bytes(data)
    (tmp_path / "b.warc.zst").write_bytes(b"")
    got = {r.record_type: r for r in warc.read_folder(spark, str(tmp_path)).collect()}
    assert set(got) == {"warcinfo", "response", "request"}
    r = got["response"]
    assert (r.http_status, bytes(r.payload), r.target_uri, r.fields["warc-concurrent-to"]) == (200, page, "http://e.org/ x", "<urn:a> <urn:b>")
    assert got["warcinfo"].http_status is None and got["warcinfo"].target_uri is None and bytes(got["request"].payload) == b""
    for bad in (frame("response", http, "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{sha1[::-1]}"), frame("x", b"", "WARC-Type: y"), data[:-4], b"junk and more", frame("x", b"").replace(b"\x28\xb5", b"\x28\xb6")):
        with pytest.raises(warc.WarcError):
            for raw in warc.decode_archive(io.BytesIO(bad)):
                warc.parse(raw)
    with pytest.raises(warc.WarcError, match="more than"):
        list(warc.decode_archive(io.BytesIO(frame("x", b"0" * 100_000)), most=50_000))


# --- tokens


def test_other_tokenizer_files_go_to_the_library_whole(tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    spec = json.load(open(path, encoding="utf-8"))
    assert token_store.ChunkEncoder(path).chunked
    spec["normalizer"] = {"type": "NFC"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    code, text = token_store.ChunkEncoder(str(tmp_path / "t.json")), "Hello there, World.\nx  y"
    assert not code.chunked and code.ids(text).tolist() == Tokenizer.from_file(str(tmp_path / "t.json")).encode(text, add_special_tokens=False).ids


# --- dedup


def test_an_inserted_line_shifts_only_its_neighbourhood():
    lines = [f"line {i * 7919 % 1009}" for i in range(200)]
    cut = lambda x: {b"\n".join(t[a:b]) for t, c in [line_dedup.chunks("\n".join(x).encode())] for a, b in c}
    before, after = cut(lines), cut(lines[:100] + ["new"] + lines[100:])
    assert len(before - after) <= 4 and len(after - before) <= 4


def test_components_of_chains_and_stars(spark):
    C.reachable(spark)
    rng = np.random.default_rng(11)
    name = [hashlib.sha1(b"%d" % i).digest() for i in range(400)]
    links = [(name[i], name[i + 1]) for i in range(150)] + [(name[200], name[i]) for i in range(201, 300)] + [(name[300 + int(a)], name[300 + int(b)]) for a, b in rng.integers(0, 90, (60, 2)) if a != b]
    root = {x: x for x in name}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    edges = C.materialize(spark.createDataFrame(links, "a binary, b binary"), "test-links")
    got = {bytes(r.node): bytes(r.label) for r in near_dup.connected(edges).collect()}
    assert got == {x: find(x) for link in links for x in link}


# --- the pipeline


def test_pipeline_stages_take_what_is_left(spark, tmp_path):
    C.reachable(spark)
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(rng.choice(words, 80)) for i in range(60)}
    passage = "\n".join(f"shared line {k} with some words in it" for k in range(5))
    texts |= {100: texts[0], 101: texts[1] + " end", 102: f"{texts[2]}\n{passage}\nx 1", 103: f"{texts[3]}\n{passage}\ny 2", 104: texts[4] + " the secret test item has exactly ten words in a row " + texts[5], 105: None, 106: ""}
    docs = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()] + [(0, texts[0], "en", "s", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("a", "the secret test item has exactly ten words in a row")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = C.load(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = C.materialize(stage(spark, now, str(tmp_path)), "test-stage")
        if name != "pieces":
            assert out.columns == now.columns
        seen[name], now = {r.doc_id: r for r in out.collect()}, out
    assert set(seen["quality"]) >= set(range(60))
    assert passage in seen["line dedup"][102].text and "shared line" not in seen["line dedup"][103].text
    near = set(seen["near dedup"])
    assert {0, 1} <= near and not {100, 101} & near and now.where("doc_id = 0").count() == 1
    assert 104 not in seen["decontamination"] and set(seen["pieces"]) == set(seen["decontamination"])
    assert all(r.decoded for r in seen["pieces"].values())
    empty = C.load(spark, str(tmp_path), "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
