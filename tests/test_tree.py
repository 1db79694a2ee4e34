"""Operators on manifests: literal scenarios, properties, sources."""

import os
import re
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeledger.functions import matchers, scalars
from treeledger.operators import diff, duplicates, legacy, merge_rules, planning, renames, series
from treeledger.plans import queries as plan_queries
from treeledger.schema import MANIFEST
from treeledger.sources import messages, tree


def row(path, kind="FILE", size=3, sha="a", mtime=1500000000, mode=None, link=None, xattr=None, uid=0, gid=0):
    mode = mode or {"FILE": 33188, "DIR": 16877, "SYMLINK": 41471}[kind]
    return (path, kind, mode, mtime, size if kind == "FILE" else None, uid, gid, link, sha if kind == "FILE" else None, xattr, [], False)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), MANIFEST)


def codes(df):
    return {r.path: r.code for r in df.collect()}


def test_deleted_and_new(spark):
    m1, m2 = table(spark, row("file1"), row("dir1", "DIR")), table(spark, row("dir1", "DIR"), row("ln1", "SYMLINK", link="INVALID"))
    assert codes(diff.diff(m2, m1)) == {"file1": "*f.delete", "ln1": ">L+++++++"}
    assert codes(diff.diff(m1, m2)) == {"file1": ">f+++++++", "ln1": "*L.delete"}


@pytest.mark.parametrize(
    "old, new, code",
    [
        (row("p"), row("p", mode=33216), ".f...p..."),
        (row("p", "DIR"), row("p", "DIR", uid=7), ".d....o.."),
        (row("p", "DIR"), row("p", "DIR", gid=7), ".d.....g."),
        (row("p", "DIR"), row("p", "DIR", xattr="x"), ".d......x"),
        (row("p"), row("p", sha="b"), ">fc......"),
        (row("p", sha=None), row("p", sha="b"), ".f......."),
        (row("p", "SYMLINK", link="a"), row("p", "SYMLINK", link="b"), ".Lc......"),
        (row("p", "DIR"), row("p", size=3), ">fcs.p..."),
    ],
)
def test_codes(spark, old, new, code):
    assert codes(diff.diff(table(spark, new), table(spark, old), include_matching=True)) == {"p": code}


def test_owner_counts_only_on_request(spark):
    a, b = table(spark, row("p")), table(spark, row("p", uid=5))
    assert diff.diff(b, a).count() == 0
    assert diff.diff(b, a, ignore_uid=False).count() == 1


def test_unknown_hash_differs_only_when_all_is_hashed(spark):
    a, b = table(spark, row("p", sha=None)), table(spark, row("p"))
    assert diff.verify(a, b).count() == 0
    assert diff.verify(a, b, checksum_all=True).count() == 1


def test_prefix_refuses_absolute_patterns(spark):
    with pytest.raises(ValueError):
        matchers.match_prefix(F.lit("a"), ["/a"])


def test_prefix_matches_whole_components(spark):
    df = spark.createDataFrame([("a",), ("a/b",), ("a/b/c",), ("a/bc",)], "path string")
    assert {r.path for r in df.where(matchers.match_prefix(F.col("path"), ["a/b"])).collect()} == {"a/b", "a/b/c"}


def test_globs(spark):
    cases = [("/a", "a", True), ("/a", "x/a", False), ("a", "x/a", True), ("*.txt", "x/y.txt", True), ("/*", "x/y", False), ("/**", "x/y", True), ("a", "a\r", False), ("d/", "d/", True), ("d/", "d", False)]
    for pattern, path, hit in cases:
        got = spark.createDataFrame([(path,)], "p string").where(F.col("p").rlike(scalars.glob_regex(pattern))).count()
        assert bool(got) == hit, (pattern, path)
    for bad in ("a?", "[a]", "a\\b"):
        with pytest.raises(ValueError):
            scalars.glob_regex(bad)


def test_pruning_hides_included_children(spark):
    df = spark.createDataFrame([("d2", True), ("d2/x", False), ("d3", True), ("d3/y", False)], "path string, d boolean")
    rules = [("exclude", "/d2/"), ("include", "/**"), ("exclude", "*")]
    assert {r.path for r in df.where(matchers.included_with_parents(F.col("path"), F.col("d"), rules)).collect()} == {"d3", "d3/y"}


def test_size_strings(spark):
    cases = {10: "10b", 51200: "50kb", int(1.45 * 1024**2): "1.4mb", 999 * 1024**3: "999gb", -2048: "-2kb", 1280: "1.2kb"}
    got = {r.n: r.s for r in spark.createDataFrame([(k,) for k in cases], "n long").select("n", scalars.size_string(F.col("n")).alias("s")).collect()}
    assert got == cases


def test_similarity_order(spark):
    m1 = table(spark, row("/tmp/a"))
    m2 = table(spark, *[row(f"/tmp/{x}") for x in "dcb"])
    got = [r.candidate for r in duplicates.ranked(duplicates.pairs(m1, m2)).orderBy("rank").collect()]
    assert got == ["/tmp/b", "/tmp/c", "/tmp/d"]
    pair = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string")
    for r in pair.select("a", "b", scalars.similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == SequenceMatcher(a=r.a, b=r.b).ratio()


def test_escape(spark):
    got = spark.createDataFrame([("a\r\\é",)], "p string").select(scalars.escape(F.col("p")).alias("e")).first().e
    assert got == r"a\r\\\xe9"


def test_rename_collisions(spark):
    m = table(spark, row("par/f1"), row("par/f2"), row("f2"), row("f3"))
    got = planning.rename_collisions(planning.rename_paths(m, "^par/", ""))
    assert [(r.path, r.new_path) for r in got.collect()] == [("par/f2", "f2")]


def test_sync_detects_rename(spark):
    old, new = table(spark, row("a", sha="x"), row("gone", sha="y")), table(spark, row("b", sha="x"))
    got = {r.path: (r.action, r.renamed_to) for r in planning.sync_plan(old, new).collect()}
    assert got == {"a": ("renamed", "b"), "gone": ("delete", None), "b": ("add", None)}


def test_rename_cap_gives_up_only_above_ten(spark, monkeypatch):
    scan = [row(f"ten/{i}", size=10, sha=f"t{i}") for i in range(10)] + [row(f"more/{i}", size=11, sha=f"m{i}") for i in range(11)] + [row(f"four/{i}", size=4, sha=f"f{i}") for i in range(4)]
    both = {"m1": table(spark, row("a", size=10, sha="t3"), row("b", size=11, sha="m3"), row("c", size=4, sha="f0")), "m2": table(spark, *scan)}
    monkeypatch.setattr(plan_queries.X, "manifest", lambda spark, sf, name: both[name])
    got = {r.path: (r.bucket, r.renames, r.first, r.too_many) for r in plan_queries.QUERIES["rename_cap"](spark, "").collect()}
    assert got == {"a": (10, 1, "ten/3", False), "b": (11, 0, None, True), "c": (4, 1, "four/0", False)}


def test_delete_duplicates_needs_a_copy_outside(spark):
    m = table(spark, row("p/a"), row("q/a"), row("p/b", sha="b", mtime=1), row("q/b", sha="b"))
    got = {r.path: r.delete for r in duplicates.deletable(m, lambda p: matchers.match_prefix(p, ["p"])).collect()}
    assert got == {"p/a": True, "p/b": False}
    assert duplicates.deletable(m, lambda p: F.lit(True)).count() == 0


def test_neighbours_skip_deleted(spark):
    s = spark.createDataFrame([("1", "DONE", True), ("2", "DELETED", True), ("3", "DONE", True)], "name string, state string, pruneable boolean")
    got = {r.name: (r.prev, r.next, r.superseding) for r in series.neighbours(s).collect()}
    assert got == {"1": (None, "3", "2"), "2": ("1", "3", "3"), "3": ("1", None, None)}


def test_tree_scan_and_manifest_files(spark, tmp_path):
    root = tmp_path / "t"
    (root / "d").mkdir(parents=True)
    (root / "d" / "f").write_bytes(b"abc")
    (root / "l").symlink_to("d/f")
    got = tree.scan_tree(spark, str(root))
    kinds = {r.path: (r.path_type, r.size, r.link_dest) for r in got.collect()}
    assert kinds == {".": ("DIR", None, None), "d": ("DIR", None, None), "d/f": ("FILE", 3, None), "l": ("SYMLINK", None, "d/f")}
    tree.write_manifest(got, str(tmp_path / "m"))
    assert diff.diff(tree.read_manifest(spark, str(tmp_path / "m")), got).count() == 0
    assert os.path.isdir(tmp_path / "m")


paths = st.text("ab/", min_size=1, max_size=6).map(lambda s: re.sub("/+", "/", s).strip("/") or "a")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(paths, st.sampled_from("xyz"), max_size=6), st.dictionaries(paths, st.sampled_from("xyz"), max_size=6))
def test_diff_properties(spark, a, b):
    ta, tb = (spark.createDataFrame([row(p, sha=s) for p, s in m.items()], MANIFEST) for m in (a, b))
    got = codes(diff.diff(tb, ta))
    want = {p: "*f.delete" for p in a.keys() - b.keys()} | {p: ">f+++++++" for p in b.keys() - a.keys()} | {p: ">fc......" for p in a.keys() & b.keys() if a[p] != b[p]}
    assert got == want
    stats = diff.diff_stats(tb, ta).first()
    assert (stats.total, stats.mismatched) == (len(a.keys() | b.keys()), len(want))


def test_deepest_rule_file_decides(spark):
    m = table(spark, row(".", "DIR"), row("a", "DIR"), row("a/b", "DIR"), row("a/x.o"), row("a/b/x.o"), row("x.o"), row("a/b/c", "DIR"), row("a/b/c/y"), row("k.o"))
    files = [(".", "exclude *.o"), ("a", "include *.o\nexclude /b/c/"), ("a/b", "# none\nexclude *.o")]
    kept = merge_rules.filter_dir_merge(m, spark.createDataFrame(files, "dir string, text string"), before=[("include", "/k.o")])
    assert sorted(r.path for r in kept.collect()) == [".", "a", "a/b", "a/x.o", "k.o"]
    assert merge_rules.filter_dir_merge(m, spark.createDataFrame([], "dir string, text string")).count() == 9


def test_legacy_sums(spark):
    files = spark.createDataFrame([("a", "0" * 31 + "1", 1), ("b", "f" * 32, 2), ("c", "f" * 32, 3), ("d", "f" * 32, None), ("tmp/e", "f" * 32, 5)], "path string, md5 string, inode long")
    sums = spark.createDataFrame([("a", "1"), ("b", "e" * 32), ("c", "0"), ("z", "0")], "path string, checksum string")
    found = legacy.verify_md5(files, sums, ignore="tmp/", seen=spark.createDataFrame([(3,), (3,), (None,)], "inode long"))
    assert {r.path: r.outcome for r in found.collect()} == {"a": "ok", "b": "mismatch", "c": "hit", "d": "missing", "tmp/e": "ignored", "z": "unverified"}


def test_two_images_of_one_name_are_an_error(spark):
    names = [("p/2020-01-01-120000.img",), ("p/2020-01-01-120000-manifest.luks.img",), ("p/other.img",)]
    assert [r.name for r in legacy.list_images(spark.createDataFrame(names[::2], "path string")).collect()] == ["2020-01-01-120000"]
    with pytest.raises(Exception, match="duplicate checkpoint"):
        legacy.list_images(spark.createDataFrame(names, "path string")).collect()


def test_messages_round_trip(spark, tmp_path):
    rows = [row(".", "DIR"), row("a\u00e9", sha="0f", size=0, xattr="ab", mtime=-5), row("l", "SYMLINK", link="a"), row("u", sha=None, size=1 << 40)]
    m = table(spark, *rows)
    encoded = [bytes(r.message) for r in messages.to_messages(m).collect()]
    (tmp_path / "m.pbdata").write_bytes(messages.manifest_bytes(encoded))
    assert sorted(map(tuple, messages.read_messages(spark, str(tmp_path / "m.pbdata")).collect())) == sorted(rows)
    # path "a", type FILE, mode 33188, spelled by hand
    assert messages.decode_row(bytes.fromhex("0a0161100118a48302"))[:5] == ("a", "FILE", 33188, 0, 0)


def test_attribute_hash(spark):
    df = spark.createDataFrame([(["user.b", "user.a", "com.apple.macl"], [b"x'", b"\x00", b"q"]), ([], []), (None, None)], "k array<string>, v array<binary>")
    want = __import__("hashlib").sha256(b"[('user.a', '\\x00'), ('user.b', \"x'\")]").hexdigest()
    assert [r[0] for r in df.select(messages.xattr_hash(F.col("k"), F.col("v"))).collect()] == [want, None, None]


def test_renames_annotate_and_hide_changes(spark):
    one = "1" * 64
    m1 = table(spark, row("file1", sha=one, size=1025), row("dir1", "DIR"))
    m2 = table(spark, row("dir1", "DIR"), row("ln1", "SYMLINK", link="INVALID"), row("file2", sha=one, size=1025))
    got = {r.path: (r.code, r.verb, r.duplicates, r.similar, r.renamed) for r in renames.diff_with_renames(m2, m1).collect()}
    assert got == {"file1": ("*f.delete", "replaced by", 1, 0, True), "file2": (">f+++++++", "replacing", 1, 0, True), "ln1": (">L+++++++", None, 0, 0, False)}
    assert [r.path for r in renames.diff_with_renames(m2, m1, ignore_renames=True).collect()] == ["ln1"]
    assert {r.path: r.duplicates for r in renames.new_renames(m1, m2).collect()} == {"file2": 1}


def test_swapped_contents_are_found_at_a_checkpoint(spark):
    a, b = table(spark, row("f8", sha="x"), row("f9", sha="y"), row("t", mtime=1)), table(spark, row("f8", sha="y"), row("f9", sha="x"), row("t", mtime=2))
    got = {r.path: (r.code, r.verb, r.duplicates) for r in renames.checkpoint_renames(a, b).collect()}
    assert got == {"f8": (">fc......", "replaced by", 1), "f9": (">fc......", "replaced by", 1), "t": (".f..t....", None, 0)}
    with_self = {r.path: (r.verb, r.duplicates, r.similar) for r in renames.diff_with_renames(b, a).collect()}
    assert with_self["t"] == ("replacing", 0, 1)


def test_many_candidates_are_counted_without_pairs(spark):
    m = table(spark, *[row(f"c{i}", mtime=i % 2) for i in range(12)], row("few", sha="z"))
    got = {r.path: (r.duplicates, r.similar) for r in renames.large_counts(m, m).collect()}
    assert got == {f"c{i}": (5, 6) for i in range(12)}


def test_lines_that_are_no_rule_are_errors():
    assert merge_rules.parse("a", "# note\n\ninclude /x\nexclude *.o") == [("include", "/a/x"), ("exclude", "*.o")]
    for bad in ("exclud *.o", "follow-symlinks x", "include"):
        with pytest.raises(ValueError, match="no rule"):
            merge_rules.parse("a", bad)


def test_malformed_sizes_are_null(spark):
    cases = {"1.2.3kb": None, "": None, "kb": None, "1.5kb": 1536, "10b": 10, "2gb": 2 << 30, "x": None, "7": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", scalars.size_bytes(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == cases


def test_text_decoding(spark):
    df = spark.createDataFrame([("a\\#012b\\#303\\x", "⁨p⁩"), ("", None)], "a string, b string")
    got = df.select(scalars.decode_octal_escapes(F.col("a")).alias("a"), scalars.strip_bidi(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("a\nbÃ\\x", "p"), ("", None)]
