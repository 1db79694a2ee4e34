"""Changes annotated with where a file's content is on the other side: renames, copies and similar files.

Candidates are counted by content before anything is joined, so that a content that many files share costs one
row. As nothing but equality counts here, a changed file may find itself on the other side, as similar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import itemize
from ..schema import COLUMNS
from .diff import compare
from .duplicates import RANK_BELOW, files

#: What must be equal, besides the content, for two files to differ in nothing but their path.
_SAME = ["mode", "mtime", "size", "link_dest", "xattr_hash", "xattr_keys", "google_drive_remote_file"]


def counts_of(manifest: DataFrame) -> DataFrame:
    """(sha256, kind, n): how many files have a content and a kind, the hash of all else that counts."""
    f = files(manifest).where("sha256 is not null").select("sha256", kind_of(*[F.col(c) for c in _SAME]).alias("kind"))
    return f.groupBy("sha256", "kind").agg(F.count("*").alias("n"))


def kind_of(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def _annotated(rows: DataFrame, side: str, other: DataFrame, when: Column, verb: str) -> DataFrame:
    """Add verb, duplicates and similar to rows whose file ``side`` is looked up in the other manifest."""
    own = F.col(f"{side}.path_type") == "FILE"
    asked = when & own & (F.col(f"{side}.size") >= 1)
    kinds = counts_of(other)
    all_ = kinds.groupBy(F.col("sha256").alias("_sha")).agg(F.sum("n").alias("_all"))
    keyed = rows.withColumns({"_asked": asked, "_key": F.when(asked, F.col(f"{side}.sha256")), "_kind": F.when(asked, kind_of(*[F.col(f"{side}.{c}") for c in _SAME]))})
    out = keyed.join(all_, F.col("_key") == F.col("_sha"), "left")
    out = out.join(kinds.select(F.col("sha256").alias("_s"), F.col("kind").alias("_k"), F.col("n").alias("_same")), (F.col("_key") == F.col("_s")) & (F.col("_kind") == F.col("_k")), "left")
    same = F.coalesce("_same", F.lit(0))
    out = out.withColumns({"verb": F.when(F.col("_asked"), verb).otherwise(F.col("verb")), "duplicates": F.when(F.col("_asked"), same).otherwise(F.col("duplicates")), "similar": F.when(F.col("_asked"), F.coalesce("_all", F.lit(0)) - same).otherwise(F.col("similar"))})
    return out.drop("_asked", "_key", "_kind", "_sha", "_all", "_s", "_k", "_same")


def _result(rows: DataFrame) -> DataFrame:
    renamed = F.col("duplicates") > 0
    severity = F.when(renamed, "purple").otherwise(itemize.severity())
    return rows.select("path", itemize.code().alias("code"), "verb", "duplicates", "similar", renamed.alias("renamed"), (F.col("duplicates") + F.col("similar") < RANK_BELOW).alias("ranked"), severity.alias("severity"))


def _started(new: DataFrame, old: DataFrame) -> DataFrame:
    return compare(new, old).where(itemize.has_diffs()).withColumns({"verb": F.lit(None).cast("string"), "duplicates": F.lit(0).cast("long"), "similar": F.lit(0).cast("long")})


def diff_with_renames(new: DataFrame, old: DataFrame, *, ignore_renames: bool = False) -> DataFrame:
    """Changed paths: code, verb (``replaced by`` for a removed file, ``replacing`` for a new or changed one),
    numbers of duplicates and similar files on the other side, renamed (there is a duplicate), ranked (the
    candidates are few enough to be listed) and severity. With ``ignore_renames`` without the renamed ones."""
    rows = _started(new, old)
    rows = _annotated(rows, "o", new, F.col("delete_path"), "replaced by")
    out = _result(_annotated(rows, "n", old, F.col("in_new"), "replacing"))
    return out.where("not renamed") if ignore_renames else out


def checkpoint_renames(basis: DataFrame, tree: DataFrame) -> DataFrame:
    """As ``diff_with_renames``, by a checkpoint's rule: new files are looked up in the basis, removed ones and
    those of other content in the tree."""
    rows = _annotated(_started(tree, basis), "n", basis, F.col("new_path"), "replacing")
    return _result(_annotated(rows, "o", tree, F.col("delete_path") | F.col("checksum_diff"), "replaced by"))


def new_renames(basis: DataFrame, scan: DataFrame) -> DataFrame:
    """New files of a scan with what the basis has of their content."""
    rows = _annotated(_started(scan, basis), "n", basis, F.col("new_path"), "replacing")
    return _result(rows).where("verb is not null")


def large_counts(subjects: DataFrame, candidates: DataFrame) -> DataFrame:
    """Files with so many candidates that these are counted only: path, duplicates, similar (own path left out)."""
    s = files(subjects).where("sha256 is not null").select("path", "sha256", F.struct(*COLUMNS).alias("n"))
    rows = s.withColumns({"verb": F.lit(None).cast("string"), "duplicates": F.lit(0).cast("long"), "similar": F.lit(0).cast("long")})
    rows = _annotated(rows, "n", candidates, F.lit(True), "replacing")
    own = files(candidates).select("path", F.struct("sha256", *_SAME).alias("own"))
    rows = rows.join(own, "path", "left")
    there = F.coalesce(F.col("own.sha256") == F.col("sha256"), F.lit(False))
    alike = there & (kind_of(*[F.col(f"own.{c}") for c in _SAME]) == kind_of(*[F.col(f"n.{c}") for c in _SAME]))
    out = rows.select("path", (F.col("duplicates") - alike.cast("long")).alias("duplicates"), (F.col("similar") - (there & ~alike).cast("long")).alias("similar"))
    return out.where(F.col("duplicates") + F.col("similar") >= RANK_BELOW)
